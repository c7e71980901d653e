"""Encoders of whole files: a list of rows as dictionaries becomes the bytes of one file that the reader of the same format reads."""

from __future__ import annotations

import io
import json
import plistlib
import sqlite3
import struct
import tarfile
import zipfile
from datetime import date, datetime
from xml.sax.saxutils import escape, quoteattr

Rows = list[dict]


def _text(x) -> str:
    return "" if x is None else x.isoformat() if isinstance(x, (date, datetime)) else str(x)


def json_file(rows: Rows) -> bytes:
    """An array of objects."""
    return (json.dumps(rows, ensure_ascii=False, default=_text) + "\n").encode()


def _yaml(x, indent: int) -> str:
    pad = "  " * indent
    if isinstance(x, dict) and x:
        return "".join(f"{pad}{json.dumps(k, ensure_ascii=False)}:" + (f"\n{_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {_yaml(v, 0)}\n") for k, v in x.items())
    if isinstance(x, list) and x:
        return "".join(f"{pad}-\n{_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}- {_yaml(v, 0)}\n" for v in x)
    return json.dumps(x, ensure_ascii=False, default=_text)


def yaml_file(rows: Rows) -> bytes:
    """One document for each row, block style, with quoted texts."""
    return "".join(f"---\n{_yaml(r, 0)}" for r in rows).encode() or b"\n"


def xml_file(rows: Rows) -> bytes:
    """<rows> of <row>, with an element for each value that is not null."""
    made = ["<?xml version=\"1.0\" encoding=\"UTF-8\"?><rows>"]
    for r in rows:
        made += ["<row>", *[f"<{k}>{escape(_text(v))}</{k}>" for k, v in r.items() if v is not None], "</row>"]
    return "".join([*made, "</rows>"]).encode()


def _bson(x) -> tuple[int, bytes]:
    if x is None:
        return 10, b""
    if isinstance(x, bool):
        return 8, bytes([x])
    if isinstance(x, int):
        return 18, struct.pack("<q", x)
    if isinstance(x, float):
        return 1, struct.pack("<d", x)
    if isinstance(x, (dict, list)):
        return (3, _document(x)) if isinstance(x, dict) else (4, _document({str(i): v for i, v in enumerate(x)}))
    t = _text(x).encode()
    return 2, struct.pack("<i", len(t) + 1) + t + b"\0"


def _document(r: dict) -> bytes:
    body = b"".join(bytes([kind]) + k.encode() + b"\0" + value for k, v in r.items() for kind, value in [_bson(v)])
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def bson_file(rows: Rows) -> bytes:
    """One document after another."""
    return b"".join(map(_document, rows))


def dbf_file(rows: Rows) -> bytes:
    """dBASE III: numbers with four decimals where they have a fraction, everything else as texts of at most 254 bytes."""
    names = list(rows[0]) if rows else []
    fields = []
    for n in names:
        values = [r[n] for r in rows if r[n] is not None]
        if values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            places = 4 if any(isinstance(v, float) for v in values) else 0
            shown = {id(r): "" if r[n] is None else f"{r[n]:.{places}f}" for r in rows}
            fields.append((n, "N", max(map(len, shown.values())), places, shown))
        else:
            shown = {id(r): _text(r[n]) for r in rows}
            fields.append((n, "C", max([1, *[len(s.encode("latin-1")) for s in shown.values()]]), 0, shown))
    if any(length > 254 or len(n) > 10 for n, _, length, _, _ in fields):
        raise ValueError("a dBASE text has at most 254 bytes and a name 10")
    head = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), 1 + sum(f[2] for f in fields))
    head += b"".join(n.encode("latin-1").ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([length, places]) + bytes(14) for n, kind, length, places, _ in fields) + b"\r"
    body = b"".join(b" " + b"".join((s[id(r)].rjust(length) if kind == "N" else s[id(r)].ljust(length)).encode("latin-1") for _, kind, length, _, s in fields) for r in rows)
    return head + body + b"\x1a"


def sqlite_file(rows: Rows) -> bytes:
    """One table `rows`; a zero byte behind the last page belongs to no page."""
    db = sqlite3.connect(":memory:")
    names = list(rows[0]) if rows else ["empty"]
    quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
    db.execute(f"create table rows ({quoted})")
    db.executemany(f"insert into rows values ({', '.join('?' * len(names))})", [[_text(v) if isinstance(v, (date, datetime)) else v for v in r.values()] for r in rows])
    db.commit()
    return db.serialize() + b"\0"


def _zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def _column(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def xlsx_file(rows: Rows) -> bytes:
    """One sheet with the names in its first row."""
    made = []
    for y, values in enumerate([list(rows[0])] + [list(r.values()) for r in rows] if rows else [], 1):
        cells = [f'<c r="{_column(x)}{y}"><v>{v!r}</v></c>' if isinstance(v, (int, float)) else f'<c r="{_column(x)}{y}" t="inlineStr"><is><t>{escape(_text(v))}</t></is></c>' for x, v in enumerate(values) if v is not None]
        made.append(f'<row r="{y}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    return _zipped({
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{''.join(made)}</sheetData></worksheet>",
    })


def ods_file(rows: Rows) -> bytes:
    """One sheet with the names in its first row."""
    def cell(v) -> str:
        if v is None:
            return "<table:table-cell/>"
        kind = f'office:value-type="float" office:value="{v!r}"' if isinstance(v, (int, float)) else 'office:value-type="string"'
        return f"<table:table-cell {kind}><text:p>{escape(_text(v))}</text:p></table:table-cell>"

    lines = ([list(rows[0])] if rows else []) + [list(r.values()) for r in rows]
    base = "urn:oasis:names:tc:opendocument:xmlns"
    body = "".join(f"<table:table-row>{''.join(map(cell, r))}</table:table-row>" for r in lines)
    content = f'<office:document-content xmlns:office="{base}:office:1.0" xmlns:table="{base}:table:1.0" xmlns:text="{base}:text:1.0"><office:body><office:spreadsheet><table:table table:name="rows">{body}</table:table></office:spreadsheet></office:body></office:document-content>'
    return _zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": content})


def matlab_file(rows: Rows) -> bytes:
    """A column vector of doubles for each numeric column; an empty element ends the file."""
    element = lambda kind, data: struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x100) + b"IM"
    for n in rows[0] if rows else []:
        values = struct.pack(f"<{len(rows)}d", *[float(r[n]) for r in rows])
        out += element(14, element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", len(rows), 1)) + element(1, n.encode()) + element(9, values))
    return out + element(1, b"")


def plist_file(rows: Rows) -> bytes:
    """An XML property list of dictionaries; nulls are left out."""
    return plistlib.dumps([{k: v for k, v in r.items() if v is not None} for r in rows], sort_keys=False)


def gedcom_file(rows: Rows) -> bytes:
    """Lines of level, id, tag and value; the rows have these names."""
    return "".join(" ".join(str(x) for x in (r["level"], r.get("id"), r["tag"], r.get("value")) if x not in (None, "")) + "\n" for r in rows).encode()


def zip_file(rows: Rows) -> bytes:
    """Members of name and content."""
    return _zipped({r["name"]: bytes(r["content"]) for r in rows})


def tar_file(rows: Rows) -> bytes:
    """Members of name and content."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for r in rows:
            i = tarfile.TarInfo(r["name"])
            i.size = len(r["content"])
            t.addfile(i, io.BytesIO(bytes(r["content"])))
    return out.getvalue()


def grid_file(rows: Rows, missing: float = -9999.0) -> bytes:
    """An ASCII grid of the cells row, col and value."""
    high, wide = (1 + max(r[k] for r in rows) for k in ("row", "col")) if rows else (0, 0)
    at = {(r["row"], r["col"]): r["value"] for r in rows}
    head = f"ncols {wide}\nnrows {high}\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value {missing!r}\n"
    return (head + "".join(" ".join(repr(at.get((y, x), missing)) for x in range(wide)) + "\n" for y in range(high))).encode()


def points_file(rows: Rows) -> bytes:
    """A shapefile of the points x and y; a null shape ends it."""
    body = b"".join(struct.pack(">ii", k, 10) + struct.pack("<idd", 1, r["x"], r["y"]) for k, r in enumerate(rows, 1)) + struct.pack(">iii", len(rows) + 1, 2, 0)
    xs, ys = [r["x"] for r in rows] or [0.0], [r["y"] for r in rows] or [0.0]
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 1, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0) + body


def html_file(rows: Rows) -> bytes:
    """A page with a table of the rows."""
    lines = "".join("<tr>" + "".join(f"<td class={quoteattr(k)}>{escape(_text(v))}</td>" for k, v in r.items()) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><body><table>{lines}</table></body></html>".encode()


#: For each format its encoder and the byte that all its files end with.
ENCODERS = {
    "json": (json_file, "\n"), "yaml": (yaml_file, "\n"), "xml": (xml_file, ">"), "bson": (bson_file, "\0"), "dbf": (dbf_file, "\x1a"), "sqlite": (sqlite_file, "\0"), "xlsx": (xlsx_file, "\0"), "ods": (ods_file, "\0"),
    "matlab": (matlab_file, "\0"), "plist": (plist_file, "\n"), "gedcom": (gedcom_file, "\n"), "zip": (zip_file, "\0"), "tar": (tar_file, "\0"), "grid": (grid_file, "\n"), "shapefile": (points_file, "\0"), "html": (html_file, ">"),
}
