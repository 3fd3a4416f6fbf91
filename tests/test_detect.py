"""Greedy matching against the plain rule: the largest score anywhere, again and again."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeweave.functions import text
from placeweave.functions.similarity import jaro_winkler
from placeweave.operators import detect, ordering, tones


def plain(wards, others):
    score = [[jaro_winkler(w, o) for o in others] for w in wards]
    out = {}
    while True:
        best = max(((s, -i, -j) for i, row in enumerate(score) for j, s in enumerate(row)), default=(0.0, 0, 0))
        if best[0] <= 0:
            return out
        out[-best[1]] = others[-best[2]]
        for i, row in enumerate(score):
            for j in range(len(others)):
                if i == -best[1] or j == -best[2]:
                    row[j] = 0.0


NAMES = st.lists(st.sampled_from(["ward", "wards", "ward_1", "home_ward", "home", "work_ward", "xa", "zz", "province", "home_province", "q", "work"]) | st.text("abw_", max_size=4), max_size=9)


@given(NAMES, NAMES)
@settings(max_examples=400, deadline=None)
def test_queue_gives_the_greedy_pairs(wards, others):
    assert detect._matched(wards, others) == plain(wards, others)


def test_marked_letters_are_all_and_no_others():
    inside = {c for c in map(chr, range(0x2000)) if __import__("re").match(f"[{text.MARKED}]", c)}
    assert inside == set(text.TONED + text.TONED.upper())


def test_dictionary_and_expression_agree(spark):
    words = ["hoà", "Thủy", "ĐƯỜNG", "của", "mía", "", None, "plain text", "quả-hoà,của", "x" * 3000 + "à", "naïve ção", "hoà hoà Hoà HOÀ", "khuỷu tay_à9"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string")
    want = [tuple(r) for r in df.select("i", text.canonical_tones(F.col("t")).alias("o")).orderBy("i").collect()]
    for most in (tones.DICTIONARY_BYTES, 0):  # beyond the bound the expression does it
        assert [tuple(r) for r in tones.with_canonical(df, F.col("t"), "o", most).select("i", "o").orderBy("i").collect()] == want


def test_numbers_from_places(spark):
    df = spark.createDataFrame([((b << 33) + p, f"{b}-{p}") for b in (9, 2, 5) for p in range(b, b + 4)], "o long, t string").repartition(3)
    got = [r.t for r in ordering.numbered(df, "o", "id").orderBy("id").collect()]
    assert got == [f"{b}-{p}" for b in (2, 5, 9) for p in range(b, b + 4)]
    plan = ordering.numbered(df, "o", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    gaps = ordering.numbered(df.filter("t <> '5-6'"), "o", "id").orderBy("id").collect()
    assert [r.id for r in gaps] == list(range(1, 12)) and "5-6" not in {r.t for r in gaps}
    assert ordering.numbered(df.limit(0), "o", "id").count() == 0
