"""Excel workbooks with the standard library: the active sheet's cached values, and a plain writer."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, time, timedelta
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


# Numbers of the built-in date and time formats.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _is_date(code: str) -> bool:
    """Whether a format shows days or times: a letter of theirs outside quotes, brackets and escapes."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.|_.|General', "", code, flags=re.I), re.I))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in styles.findall("m:numFmts/m:numFmt", _NS) if _is_date(f.get("formatCode", ""))}
    plain = {int(f.get("numFmtId")) for f in styles.findall("m:numFmts/m:numFmt", _NS)} - own
    return {i for i, x in enumerate(styles.findall("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", "0")) in (DATES | own) - plain}


def moment(serial: float, from_1904: bool = False) -> str:
    """A serial day number as ISO text; below one it is a time of day."""
    if 0 <= serial < 1 and not from_1904:
        return (datetime.min + timedelta(seconds=round(serial * 86400))).time().isoformat() if serial else time().isoformat()
    if not from_1904 and serial < 60:
        serial += 1  # the format counts a 29 February 1900
    base = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    return (base + timedelta(days=int(serial), milliseconds=round((serial - int(serial)) * 86_400_000))).isoformat()


def number(text: str) -> str:
    """A stored number as Python prints it: no exponents or stray digits where the value needs none."""
    try:
        return str(int(text))
    except ValueError:
        return repr(float(text))


def read(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the active sheet one by one as texts, header first; absent cells are None, dates are ISO texts.

    A row is as long as its last cell's place. The sheet is never held whole.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in _each(z, "xl/sharedStrings.xml", "si"):
                strings.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        view = book.find("m:bookViews/m:workbookView", _NS)
        active = int(view.get("activeTab", "0")) if view is not None else 0
        sheet = book.findall("m:sheets/m:sheet", _NS)[active]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheet.get(_REL)].lstrip("/")
        dates = _date_styles(z)
        properties = book.find("m:workbookPr", _NS)
        from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        n = 0
        for row in _each(z, target if target.startswith("xl/") else f"xl/{target}", "row"):
            while n < int(row.get("r", n + 1)) - 1:
                n += 1
                yield []
            cells: list[str | None] = []
            for k, c in enumerate(row.findall("m:c", _NS)):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [None] * (at + 1 - len(cells))
                value, kind = c.find("m:v", _NS), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif value is not None and value.text is not None:
                    cells[at] = _shown(value.text, kind, strings, int(c.get("s", "0")) in dates, from_1904)
            n += 1
            yield cells


def _each(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """A part's elements of a tag, each dropped when the next one is asked for."""
    tag, above = f"{{{_NS['m']}}}{tag}", []
    with z.open(name) as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag == tag:
                yield e
                above[-1].remove(e)


def _shown(text: str, kind: str | None, strings: list[str], date: bool, from_1904: bool) -> str:
    if kind == "s":
        return strings[int(text)]
    if kind == "b":
        return {"0": "False", "1": "True"}.get(text, text)
    if kind in (None, "n"):
        return moment(float(text), from_1904) if date else number(text)
    return text


def header_of(row: list[str | None]) -> list[str]:
    return [f"col_{i}" if h is None else str(h) for i, h in enumerate(row)]


#: Rows that a sheet holds, its header among them.
SHEET_ROWS = 1_048_576


def write(path: str | BinaryIO, header: list[str], rows: Iterable[Iterable], comment: bytes = b"") -> None:
    """A workbook with one sheet, streamed row by row; a sheet holds SHEET_ROWS rows at most. comment: the archive's, its last bytes."""
    def cell(i: int, n: int, v) -> str:
        if v is None:
            return ""
        return f'<c r="{_letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = comment
        for name, text in parts.items():
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
            n = 0
            for n, row in enumerate([header], 1):
                f.write(f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(row))}</row>'.encode())
            for n, row in enumerate(rows, 2):
                if n > SHEET_ROWS:
                    raise ValueError(f"a sheet holds {SHEET_ROWS:,} rows at most")
                f.write(f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
