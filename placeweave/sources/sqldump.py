"""INSERT statements of a SQL dump: parser and literal writer.

Comments are removed and white space is folded before anything else, inside literals too. A quote
after a backslash does not end a literal; doubled quotes stay doubled. `unescape` undoes the
backslash that the writer puts before a quote.
"""

from __future__ import annotations

import re

from .formats import DumpError, SqlDump


def typed(text: str, quoted: bool, unescape: bool = False):
    """A literal's value: null, text, int, float; anything else stays text."""
    if quoted:
        return text.replace("\\'", "'") if unescape else text
    if text.lower() == "null":
        return None
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text


def rows_of(values: str, unescape: bool = False):
    """Rows of a VALUES list; an opening bracket outside quotes starts the row anew."""
    row, cell, inside, quoted, was_quoted, prior = [], [], False, False, False, ""
    for ch in values:
        if ch == "'" and prior != "\\":
            if not quoted:
                cell, was_quoted = [*cell, "''"] if was_quoted else [], True  # doubled quotes stay
            quoted = not quoted
        elif quoted:
            cell.append(ch)
        elif ch == "(":
            row, cell, inside, was_quoted = [], [], True, False
        elif ch in ",)" and inside:
            text = "".join(cell)
            row.append(typed(text if was_quoted else text.strip(), was_quoted, unescape))
            cell, was_quoted = [], False
            if ch == ")":
                inside = False
                yield row
        elif not was_quoted:
            cell.append(ch)
        prior = ch


def columns_of(shown: str) -> list[str]:
    """Names in a statement's column list."""
    return [c.strip().strip("`").strip() for c in re.sub(r"\s+", " ", shown).split(",")]


def row_of(raw: str, unescape: bool = False) -> list | None:
    """The values of one row's text in brackets."""
    return next(rows_of(re.sub(r"\s+", " ", raw), unescape), None)


def parse(text: str, unescape: bool = False) -> tuple[str, list[str], list[list], list[str]]:
    """table, columns (of the first statement), rows, remarks on skipped rows, of a dump in memory."""
    rule, state, depth, held, records = SqlDump(), SqlDump.states[0], 0, "", []
    *whole, rest = text.split(rule.separator)
    for chunk, followed in [*((c, True) for c in whole), (rest, False)]:
        state, depth, pieces = rule.cut(state, depth, chunk, followed)
        for shown, ends, fresh in pieces:
            held = shown if fresh else held + shown
            if ends:
                records.append(held.partition("\0"))
                held = ""
    # A statement without its end counts for nothing.
    records = [r for r in records if state[1] == "seek" or r[0][1:] != str(depth)]
    heads = [r[2].split("\0") for r in records if r[0][0] == "H"]
    if not heads:
        raise DumpError("no INSERT statement with a column list")
    if len(tables := {t for t, _ in heads}) > 1:
        raise DumpError(f"several tables: {sorted(tables)}")
    columns = columns_of(heads[0][1])
    rows, remarks = [], []
    for row in [row_of(r[2], unescape) for r in records if r[0][0] == "R"]:
        if len(row) == len(columns):
            rows.append(row)
        else:
            remarks.append(f"{len(row)} values for {len(columns)} columns")
    if not rows:
        raise DumpError("no row fits the columns")
    return tables.pop(), columns, rows, remarks
