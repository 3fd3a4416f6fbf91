"""The automata of the splitting scan: CSV with quoted line breaks, JSON arrays, SQL dumps."""

from __future__ import annotations

import re

from .blocks import Piece


class CsvLines:
    """Chunks are lines. A quote opens a value only at its begin; a doubled quote is none; what follows a closing quote goes on to the delimiter."""

    separator = "\n"
    states = ("out", "in")

    def step(self, state, chunk: str) -> tuple:
        return ("in" if self._inside(chunk, state == "in") else "out"), 0

    def cut(self, state, depth: int, chunk: str, followed: bool = True) -> tuple:
        if state == "out" and not chunk.strip():
            return state, depth, []  # an empty line is no record
        onward, _ = self.step(state, chunk)
        open_ = onward == "in"
        return onward, depth, [Piece(chunk + "\n" if open_ and followed else chunk, not open_)]

    def neutral(self, state, depth: int) -> bool:
        return state == "out"

    def goes_on(self, state, depth: int) -> bool:
        return False

    def last(self, state, depth: int) -> tuple:
        return state, depth

    @staticmethod
    def _inside(line: str, inside: bool) -> bool:
        """Whether a line ends inside a quoted value."""
        if '"' not in line:
            return inside
        at = 0
        while True:
            if inside:
                at = line.find('"', at)
                while at >= 0 and line.startswith('""', at):
                    at = line.find('"', at + 2)
                if at < 0:
                    return True
                at = line.find(",", at + 1)
                if at < 0:
                    return False
                at += 1
            # At a value's begin; values without quotes are passed over.
            if not line.startswith('"', at):
                at = line.find(',"', at)
                if at < 0:
                    return False
                at += 1
            at, inside = at + 1, True


class JsonArray:
    """Chunks end with a closing brace. A record is an object of the outermost array; anything else there is a record that does not parse.

    Depth counts open brackets: 1 inside the array. An array that isn't closed goes on in the next file.
    """

    separator = "}"
    states = ("out", "in")
    _string = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.S)
    _rest = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
    _lead = {0: re.compile(r"\s*\[\s*(?=\{)"), 1: re.compile(r"\s*,\s*(?=\{)")}
    _empty = {0: re.compile(r"\s*(\[\s*\]?\s*)?"), 1: re.compile(r"\s*,?\s*\]?\s*")}

    def step(self, state, chunk: str) -> tuple:
        onward, deeper = self._moved(state, chunk)
        return onward, deeper - (onward == "out")

    def _moved(self, state, chunk: str) -> tuple:
        """State and depth gained before the separator."""
        if state == "in":
            end = self._rest.match(chunk)
            if not end:
                return "in", 0
            chunk = chunk[end.end() :]
        if '"' in chunk:
            chunk = self._string.sub("", chunk)
        outside, quote, _ = chunk.partition('"')
        deeper = outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
        return ("in" if quote else "out"), deeper

    def cut(self, state, depth: int, chunk: str, followed: bool = True) -> tuple:
        onward, deeper = self._moved(state, chunk)
        closing = followed and onward == "out"
        now = depth + deeper - closing
        text, fresh = chunk + "}" if followed else chunk, False
        if self.neutral(state, depth):
            level, shown = min(max(depth, 0), 1), chunk.removeprefix("﻿")
            if not followed and self._empty[level].fullmatch(shown):
                return onward, now, []
            lead = self._lead[level].match(shown) if depth >= 0 else None
            wrong = "" if lead or not shown.lstrip().startswith("{") else "(no comma)"  # it would parse
            fresh, text = True, (shown[lead.end() :] if lead else wrong + shown) + ("}" if followed else "")
            return onward, now, [Piece(text, onward == "out" and now <= 1, fresh)]
        return onward, now, [Piece(text, closing and now <= 1)]

    def neutral(self, state, depth: int) -> bool:
        return state == "out" and depth <= 1

    def goes_on(self, state, depth: int) -> bool:
        return depth > 0

    def last(self, state, depth: int) -> tuple:
        """The file's last chunk had no brace behind it."""
        return state, depth + (state == "out")


class DumpError(ValueError):
    """No statement, several tables, or no row of the right width."""


class SqlDump:
    """Chunks end with a closing bracket. Records are the heads of INSERT statements and their rows, as `H`/`R`, number of the statement, NUL, text.

    State: the comment and the part of a statement that a chunk begins in. Comments are taken out first,
    in literals too. A statement's values begin behind its column list and VALUES, and end where `;`
    follows a closing bracket directly, in a literal too; an opening bracket outside quotes begins a row
    anew. `+`: behind a closing bracket there were comments only; begin: nothing since VALUES; bare: a
    bracket only. Depth counts the statements. A comment that isn't closed reaches to the end of the file.
    """

    separator = ")"
    states = tuple((comment, part) for comment in ("", "-", "*") for part in ("seek", "head", "begin", "bare", "list", "list'", "row", "row'", "list+", "list'+", "row+", "row'+"))
    _columns = re.compile(r"[\w\s`,]+")
    _name = re.compile(r"[\w-]+")
    _values = re.compile(r"\s*VALUES\s*", re.I)
    _marks = re.compile(r"(?<!\\)'|\(")

    def step(self, state, chunk: str) -> tuple:
        onward, depth, _ = self.cut(state, 0, chunk)
        return onward, depth

    def goes_on(self, state, depth: int) -> bool:
        return state[1] in ("begin", "list")  # parts of one statement, cut between its rows

    def last(self, state, depth: int) -> tuple:
        return state, depth

    def neutral(self, state, depth: int) -> bool:
        return not state[1].startswith(("row", "head"))

    @staticmethod
    def _plain(comment: str, chunk: str) -> tuple[str, str]:
        """The chunk without its comments, and the comment that goes on behind it."""
        kept, at = [], 0
        while True:
            if comment:
                close = "\n" if comment == "-" else "*/"
                end = chunk.find(close, at)
                if end < 0:
                    return "".join(kept), comment
                at, comment = end + len(close), ""
            line, block = chunk.find("--", at), chunk.find("/*", at)
            if line < 0 and block < 0:
                kept.append(chunk[at:])
                return "".join(kept), ""
            begin = min(x for x in (line, block) if x >= 0)
            kept.append(chunk[at:begin])
            comment, at = ("-" if begin == line else "*"), begin + 2

    def _head(self, text: str) -> tuple[str, str] | None:
        """Table and column list, if the text ends with a statement's head."""
        before, bracket, columns = text.rpartition("(")
        words = before.split()
        if not bracket or len(words) < 3 or words[-2].lower() != "into" or not words[-3].lower().endswith("insert") or not self._columns.fullmatch(columns):
            return None
        parts = [p.strip("`") for p in words[-1].split(".")]
        return (".".join(parts), columns) if len(parts) <= 2 and all(map(self._name.fullmatch, parts)) else None

    def cut(self, state, depth: int, chunk: str, followed: bool = True) -> tuple:
        before, part = state
        text, comment = self._plain(before, chunk)
        closed = followed and not comment  # the bracket behind the chunk is none of a comment
        pieces: list[Piece] = []
        beside = part.endswith("+") or (not before and part in ("list", "list'", "row", "row'"))  # directly behind a bracket
        part = part.rstrip("+")
        if part == "head":
            if found := self._values.match(text):
                part, text = "begin", text[found.end() :]
                pieces = [Piece("", True)]
            elif comment and not text.strip():
                return (comment, part), depth, []
            else:
                part, pieces = "seek", [Piece("", False, True)]
        elif beside and text.startswith(";"):
            pieces = [Piece("", False, True)] if part.startswith("row") else []  # the row under way had no end
            part, text = "seek", text[1:]
        elif beside and comment and not text:
            return (comment, part + "+"), depth, []
        if part in ("begin", "bare"):
            if part == "begin" and not text.strip():
                # A bracket without anything before it ends no statement.
                return (comment, "bare" if closed else "begin"), depth, pieces
            part = "list"
        if part == "seek":
            head = self._head(text) if closed else None
            if head:
                return (comment, "head"), depth + 1, [*pieces, Piece(f"H{depth + 1}\0{head[0]}\0{head[1]}", False, True)]
            if comment and text.split()[-3:-1] and [w.lower()[-6:] for w in text.split()[-3:-1]] == ["insert", "into"]:
                raise DumpError("a comment with a bracket stands in the head of a statement")
            return (comment, "seek"), depth, pieces
        quoted, row, begin = part.endswith("'"), part.startswith("row"), -1
        for mark in self._marks.finditer(text):
            if mark[0] == "'":
                quoted = not quoted
            elif not quoted:
                row, begin = True, mark.start()
        ends = closed and row and not quoted
        onward = (comment, "list" if ends else ("row" if row else "list") + ("'" if quoted else ""))
        shown = (text if begin < 0 else f"R{depth}\0{text[begin:]}") + (")" if closed else "")
        return onward, depth, [*pieces, Piece(shown, ends, begin >= 0)] if row else pieces
