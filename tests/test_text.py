import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeweave.functions import text
from placeweave.functions.similarity import jaro_winkler
from placeweave.operators.detect import group_columns, threshold
from placeweave.operators.ordering import sample_size, suggested_workers
from placeweave.tasks import plain, progress

PLACES = [
    ("Tỉnh Hà Giang", "hà giang"), ("TP. Hồ Chí Minh", "hồ chí minh"), ("TP.HCM", "hcm"), ("Quận 01", "1"), ("Phường 10", "10"), ("Thị xã Hoà Thành", "hòa thành"),
    ("thị trấn Phước Thuỷ", "phứơc thuỷ"), ("Huyện Đường", "đừơng"), ("X. Của", "cuả"), ("Hanoi Province", "hanoi"), ("District of Ba Dinh", "ba dinh"),
    ("Long An (cũ)", "long an cũ"), ("An-Bình", "an bình"), ("Tpx", "x"), ("Townsend ward", "townsend"), ("0", ""), ("  ", ""), (None, ""),
]


def test_place_keys(spark):
    df = spark.createDataFrame(PLACES, "raw string, want string").withColumn("got", text.place_key(F.col("raw")))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_canonical_is_stable(spark):
    words = [("hoà",), ("thuỷ",), ("mía",), ("Quyền",), ("a_b 12 của",), ("hòa",), (None,)]
    once = spark.createDataFrame(words, "w string").select(text.canonical_tones(F.col("w")).alias("w"))
    twice = once.select("w", text.canonical_tones(F.col("w")).alias("v"))
    assert all(r.w == r.v for r in twice.collect())


def test_numeric(spark):
    rows = [("1", 1.0), (" 2.5 ", 2.5), ("1d", None), ("0x1p3", None), ("nan", None), ("", None), (None, None), ("1e3", 1000.0)]
    df = spark.createDataFrame(rows, "raw string, want double").withColumn("got", text.numeric(F.col("raw")))
    assert all(r.got == r.want for r in df.collect())


def test_jaro_winkler():
    assert round(jaro_winkler("ward_name", "ward_id"), 5) == 0.85397
    assert jaro_winkler("", "x") == 0 and jaro_winkler(None, "x") == 0 and jaro_winkler("A", "a") == 1


@given(st.text(max_size=8), st.text(max_size=8))
def test_jaro_winkler_bounds(a, b):
    assert 0 <= jaro_winkler(a, b) <= 1.0000001


@pytest.mark.parametrize(("rows", "want"), [(0, 0), (1, 10), (1000, 10), (5000, 50), (100000, 500)])
def test_sample_size(rows, want):
    assert sample_size(rows) == want


def test_small_rules():
    assert [suggested_workers(*x) for x in ((14999, 0), (15000, 0), (30000, 25), (150000, 0))] == [1, 2, 4, 8]
    assert [threshold(n) for n in (3, 10, 500)] == [2, 8, 400]
    assert [progress(x) for x in (66.7, -1, 250)] == [66, 0, 100]
    assert plain({"a": float("nan"), "b": b"x", "c": [1, None]}) == {"a": None, "b": None, "c": [1, None]}


def test_group_columns():
    one = {k: [] for k in ("id_provinces", "id_districts", "id_wards", "provinces", "districts", "wards")}
    assert group_columns(one) == []
    single = group_columns(one | {"provinces": ["p"], "wards": ["w"]})
    assert [(g.province, g.district, g.ward) for g in single] == [("p", None, "w")]
    two = group_columns(one | {"provinces": ["home_p", "work_p"], "districts": ["home_d"], "wards": ["home_w", "work_w"]})
    assert {g.ward: g.province for g in two} == {"home_w": "home_p", "work_w": "work_p"}
