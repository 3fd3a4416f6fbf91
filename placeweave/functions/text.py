"""Place names and tone marks as Catalyst expressions: no UDF, whole-stage friendly."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twelve vowels with their six tones (none, grave, acute, hook, tilde, dot).
FORMS = "aàáảãạăằắẳẵặâầấẩẫậeèéẻẽẹêềếểễệiìíỉĩịoòóỏõọôồốổỗộơờớởỡợuùúủũụưừứửữựyỳýỷỹỵ"
VOWELS = FORMS[::6]
TONED = "".join(f for i, f in enumerate(FORMS) if i % 6)
PLAIN = "".join(v * 5 for v in VOWELS)
def char_class(chars: str) -> str:
    """Characters for the inside of a pattern's brackets, neighbours as ranges: each range is one test of a character, each single one another."""
    codes, parts = sorted(set(map(ord, chars))), []
    for c in codes:
        if parts and parts[-1][1] == c - 1:
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in parts)


#: Any letter with a tone mark, for the inside of a pattern's brackets.
MARKED = char_class(TONED + TONED.upper())

#: Vowels that draw the tone mark to themselves.
STRONG = "êơâăôư"

# White space as Python's strip() sees it, and the name parts that are taken off.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PREFIXES = (
    r"tp\.", r"tx\.", r"tt\.", r"q\.", r"x\.", r"p\.", r"t\.", r"h\.",
    "thành phố", "tỉnh", "tp", "thủ đô", "td",
    "huyện", "quận", "thị xã",
    "xã", "phường", "thị trấn",
    "district of", "dist of", "county of", "town of", "ward of", "commune of", "township of",
)
SUFFIXES = ("province", "prov", "district", "dist", "county", "town", "ward", "commune", "township")


def compose(c: Column) -> Column:
    """Vowels and tone marks that are written as letters of their own, joined to the one letter each (canonical composition)."""
    letters = [x for x in FORMS + FORMS.upper() + "đĐ" if len(unicodedata.normalize("NFD", x)) > 1]
    whole = c
    # Letters of more parts first, so that no mark is left over.
    for x in sorted(letters, key=lambda x: -len(unicodedata.normalize("NFD", x))):
        whole = F.replace(whole, F.lit(unicodedata.normalize("NFD", x)), F.lit(x))
    return F.when(c.rlike(r"\p{M}"), whole).otherwise(c)


def strip(c: Column) -> Column:
    """Both ends freed of Unicode white space (trim() knows U+0020 only)."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def _bound(f, **values: Column) -> Column:
    """f over a struct of values, each computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f)[0]


def canonical_run(run: Column) -> Column:
    """One run of word characters with its tone mark (the last one found) on the canonical vowel."""
    plain = F.translate(run, TONED + FORMS.upper(), PLAIN + "".join(v * 6 for v in VOWELS))
    mark = F.lower(F.regexp_extract(run, f"^.*([{MARKED}])", 1))
    # Most runs have no mark: one look at a run settles that.
    return F.when(~run.rlike(f"[{MARKED}]"), run).otherwise(_bound(lambda s: _marked(run, s["plain"], s["mark"]), plain=plain, mark=mark))


#: Each vowel as one of two signs, so that places are found by plain search: the strong ones, then the others.
_SIGNS = "".join("\x01" if v in STRONG else "\x02" for v in VOWELS)


def _place(plain: Column, signs: Column) -> Column:
    """Where the mark belongs: the first strong vowel; else the first of one, or of two unless that is u or i; else the second."""
    strong, first = F.instr(signs, F.lit("\x01")), F.instr(signs, F.lit("\x02"))
    count = F.length(signs) - F.length(F.replace(signs, F.lit("\x02"), F.lit("")))
    second = first + F.instr(F.substr(signs, first + 1), F.lit("\x02"))
    alone = (count == 1) | ((count == 2) & ~F.substr(plain, first, F.lit(1)).isin("u", "i"))
    return F.when(strong > 0, strong).when(alone, first).otherwise(second)


def _marked(run: Column, plain: Column, mark: Column) -> Column:
    place = _bound(lambda s: _place(plain, s["signs"]), signs=F.translate(plain, VOWELS, _SIGNS))
    tone = (F.instr(F.lit(TONED), mark) - 1) % 5 + 1

    def put(s: Column) -> Column:
        vowel = F.substr(plain, s["place"], F.lit(1))
        form = F.substr(F.lit(FORMS), (F.instr(F.lit(VOWELS), vowel) - 1) * 6 + s["tone"] + 1, F.lit(1))
        return F.concat(F.substr(plain, F.lit(1), s["place"] - 1), form, F.substr(plain, s["place"] + 1))

    head = F.substr(run, F.lit(1), F.lit(1))
    capital = (head == F.upper(head)) & (head != F.lower(head))
    done = _bound(put, place=place, tone=tone)
    return _bound(lambda s: F.when(capital, F.concat(F.upper(F.substr(s["done"], F.lit(1), F.lit(1))), F.lower(F.substr(s["done"], F.lit(2))))).otherwise(s["done"]), done=done)


def canonical_tones(c: Column) -> Column:
    """Every word run with its tone mark in canonical place; everything else unchanged. Null stays null."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))
    marked = c.rlike(f"[{MARKED}]")  # most texts without a tone mark need no look at their words
    return F.when(marked, F.array_join(F.transform(runs, canonical_run), "")).otherwise(c)


def normalize_place(c: Column) -> Column:
    """Lower-cased name without administrative prefix and suffix, punctuation runs and leading zeros."""
    s = F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
    s = strip(F.regexp_replace(s, f"^(?:{'|'.join(PREFIXES)}){SPACE}*", ""))
    s = strip(F.regexp_replace(s, f"{SPACE}*(?:{'|'.join(SUFFIXES)})\\z", ""))
    s = F.regexp_replace(s, r"[,()\[\]\-+]+", " ")
    s = F.regexp_replace(s, f"(?:[.,/]|{SPACE})+\\z", "")
    s = strip(F.regexp_replace(s, f"{SPACE}+", " "))
    return strip(F.regexp_replace(s, "^0+", ""))


def place_key(c: Column) -> Column:
    """One part of a lookup key; null and blank give ''. The name is bound, as the tones look at it several times."""
    return _bound(lambda s: strip(canonical_tones(s["name"])), name=normalize_place(c))


#: Numbers that pandas' to_numeric takes, but for missing ones.
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def numeric(c: Column) -> Column:
    """The number a text holds, else null; `1d`, hexadecimal and nan are no numbers here."""
    text = c.cast("string")
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def sql_literal(c: Column, kind: str) -> Column:
    """A value as the SQL sink writes it: NULL, quoted text with escaped quotes, anything else as it prints."""
    text = c.cast("string")
    shown = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")) if kind == "string" else text
    return F.coalesce(shown, F.lit("NULL"))


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
