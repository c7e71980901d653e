"""Parsers of file formats, each registered as a handler. Rows are tuples in the order of the handler's schema."""

from __future__ import annotations

import io
import json
import plistlib
import re
import sqlite3
import struct
import tarfile
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

from .files import Handler, register


def _plain(x):
    """A value as JSON can hold it."""
    if isinstance(x, bytes):
        return x.hex()
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and x != x:
        return None
    return x if isinstance(x, (str, int, float, bool)) or x is None else str(x)


def _json(x) -> str:
    return json.dumps(_plain(x), ensure_ascii=False)


def sqlite_rows(b: bytes) -> Iterator[tuple]:
    """Every row of every table, the schema table included: table, rowid, row as a JSON object by column name."""
    db = sqlite3.connect(":memory:")
    db.deserialize(b)
    names = ["sqlite_master", *[r[0] for r in db.execute("select name from sqlite_master where type = 'table' order by rootpage")]]
    for name in names:
        q = '"' + name.replace('"', '""') + '"'
        try:
            cur = db.execute(f"select rowid, * from {q} order by rowid")
        except sqlite3.OperationalError:  # a table without row ids
            cur = db.execute(f"select null, * from {q}")
        cols = [d[0] for d in cur.description][1:]
        for r in cur:
            yield name, r[0], _json(dict(zip(cols, r[1:], strict=True)))


register(Handler("sqlite", ("sqlite", "sqlite3", "db", "db3"), ("application/vnd.sqlite3",), "table string, rowid long, row string", sqlite_rows, lambda b: 2 if b.startswith(b"SQLite format 3\0") else -2))


def dbf_table(b: bytes, include_deleted: bool = False) -> Iterator[dict]:
    """Records of a dBASE file as dictionaries; deleted ones only on demand. Memo fields give their block number."""
    n, head, size = struct.unpack_from("<IHH", b, 4)
    fields, at = [], 32
    while at + 32 <= head and b[at] != 0x0D:
        name = b[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(b[at + 11]), b[at + 16], b[at + 17]))
        at += 32
    for k in range(n):
        r = b[head + k * size : head + (k + 1) * size]
        if len(r) < size:
            return
        if r[:1] == b"*" and not include_deleted:
            continue
        out, p = {"__deleted": True} if include_deleted and r[:1] == b"*" else {}, 1
        for name, kind, length, _decimals in fields:
            raw = r[p : p + length]
            p += length
            out[name] = _dbf_value(kind, raw)
        yield out


def _dbf_value(kind: str, raw: bytes):
    text = raw.decode("latin-1").strip(" \0")
    if kind in "NF":
        try:
            return None if not text or "*" in text else float(text) if "." in text or "e" in text.lower() else int(text)
        except ValueError:
            return None
    if kind == "L":
        return True if text in ("T", "t", "Y", "y") else False if text in ("F", "f", "N", "n") else None
    if kind == "D":
        return f"{text[:4]}-{text[4:6]}-{text[6:8]}" if len(text) == 8 else None
    if kind == "I" and len(raw) == 4:
        return struct.unpack("<i", raw)[0]
    if kind in "OB" and len(raw) == 8:
        return struct.unpack("<d", raw)[0]
    if kind == "Y" and len(raw) == 8:
        return struct.unpack("<q", raw)[0] / 10000
    if kind == "T" and len(raw) == 8:
        day, ms = struct.unpack("<ii", raw)
        return (datetime(1970, 1, 1) + timedelta(days=day - 2440588, milliseconds=ms)).isoformat() if day else None
    return text


register(Handler("dbf", ("dbf",), ("application/dbase",), "row string", lambda b: ((_json(r),) for r in dbf_table(b)), lambda b: 1 if b[:1] in (b"\x02", b"\x03", b"\x30", b"\x31", b"\x83", b"\xf5") and len(b) > 32 else -2))

#: Shape types (fixed values).
SHAPES = {0: "null", 1: "point", 3: "polyline", 5: "polygon", 8: "multipoint", 11: "pointz", 13: "polylinez", 15: "polygonz", 18: "multipointz", 21: "pointm", 23: "polylinem", 25: "polygonm", 28: "multipointm", 31: "multipatch"}


def shapes(b: bytes) -> Iterator[tuple]:
    """Records of a shapefile: number, type, bounding box, first point of each part, points, z and m values."""
    at = 100
    while at + 12 <= len(b):
        number, words = struct.unpack_from(">ii", b, at)
        r = b[at + 8 : at + 8 + words * 2]
        at += 8 + words * 2
        kind = struct.unpack_from("<i", r)[0]
        name = SHAPES.get(kind, str(kind))
        if kind == 0:
            yield number, name, None, None, None, None, None
        elif kind in (1, 11, 21):
            v = struct.unpack_from(f"<{(len(r) - 4) // 8}d", r, 4)
            z = [v[2]] if kind == 11 else None
            m = [v[-1]] if (kind == 21 and len(v) > 2) or (kind == 11 and len(v) > 3) else None
            yield number, name, [v[0], v[1], v[0], v[1]], [0], [list(v[:2])], z, m
        else:
            box = list(struct.unpack_from("<4d", r, 4))
            p = 36
            if kind in (8, 18, 28):
                parts, n = [0], struct.unpack_from("<i", r, p)[0]
                p += 4
            else:
                k, n = struct.unpack_from("<2i", r, p)
                parts = list(struct.unpack_from(f"<{k}i", r, p + 8))
                p += 8 + 4 * k * (2 if kind == 31 else 1)
            xy = struct.unpack_from(f"<{2 * n}d", r, p)
            p += 16 * n
            z = m = None
            if kind in (13, 15, 18, 31):
                z = list(struct.unpack_from(f"<{n}d", r, p + 16))
                p += 16 + 8 * n
            if len(r) >= p + 16 + 8 * n and kind > 10:
                m = list(struct.unpack_from(f"<{n}d", r, p + 16))
            yield number, name, box, parts, [list(x) for x in zip(xy[::2], xy[1::2], strict=True)], z, m


register(Handler("shapefile", ("shp",), ("application/x-esri-shape",), "number int, type string, bbox array<double>, parts array<int>, points array<array<double>>, z array<double>, m array<double>", shapes, lambda b: 2 if b[:4] == b"\x00\x00\x27\x0a" else -2))


def bson_value(b: bytes, at: int, kind: int):
    """A BSON value and where it ends."""
    if kind == 0x01:
        return struct.unpack_from("<d", b, at)[0], at + 8
    if kind in (0x02, 0x0D, 0x0E):
        n = struct.unpack_from("<i", b, at)[0]
        return b[at + 4 : at + 3 + n].decode("utf-8", "replace"), at + 4 + n
    if kind in (0x03, 0x04):
        pairs, end = bson_document(b, at)
        return (dict(pairs) if kind == 3 else [v for _, v in pairs]), end
    if kind == 0x05:
        n = struct.unpack_from("<i", b, at)[0]
        return b[at + 5 : at + 5 + n], at + 5 + n
    if kind in (0x06, 0x0A, 0x7F, 0xFF):
        return {0x7F: "maxkey", 0xFF: "minkey"}.get(kind), at
    if kind == 0x07:
        return b[at : at + 12].hex(), at + 12
    if kind == 0x08:
        return b[at] != 0, at + 1
    if kind == 0x09:
        return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=struct.unpack_from("<q", b, at)[0])).isoformat(), at + 8
    if kind == 0x0B:
        p, q = b.index(b"\0", at), b.index(b"\0", b.index(b"\0", at) + 1)
        return f"/{b[at:p].decode()}/{b[p + 1 : q].decode()}", q + 1
    if kind == 0x0C:
        n = struct.unpack_from("<i", b, at)[0]
        return {"ref": b[at + 4 : at + 3 + n].decode(), "id": b[at + 4 + n : at + 16 + n].hex()}, at + 16 + n
    if kind == 0x0F:
        n = struct.unpack_from("<i", b, at)[0]
        m = struct.unpack_from("<i", b, at + 4)[0]
        return {"code": b[at + 8 : at + 7 + m].decode(), "scope": dict(bson_document(b, at + 8 + m)[0])}, at + n
    if kind == 0x10:
        return struct.unpack_from("<i", b, at)[0], at + 4
    if kind == 0x11:
        return struct.unpack_from("<Q", b, at)[0], at + 8
    if kind == 0x12:
        return struct.unpack_from("<q", b, at)[0], at + 8
    if kind == 0x13:
        return b[at : at + 16].hex(), at + 16
    raise ValueError(f"BSON type {kind}")


def bson_document(b: bytes, at: int = 0) -> tuple[list[tuple], int]:
    """Pairs of a BSON document, in order, and where it ends."""
    end = at + struct.unpack_from("<i", b, at)[0]
    at, out = at + 4, []
    while b[at]:
        kind = b[at]
        stop = b.index(b"\0", at + 1)
        name = b[at + 1 : stop].decode("utf-8", "replace")
        value, at = bson_value(b, stop + 1, kind)
        out.append((name, value))
    return out, end


def bson_rows(b: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(b):
        pairs, at = bson_document(b, at)
        yield (_json(dict(pairs)),)


register(Handler("bson", ("bson",), ("application/bson",), "row string", bson_rows, lambda b: 1 if len(b) > 4 and struct.unpack_from("<i", b)[0] <= len(b) and b[4] in range(1, 20) else -1))


def json_rows(b: bytes) -> Iterator[tuple]:
    """Elements of an array, or the one value; key order is kept."""
    x = json.loads(b.decode("utf-8-sig"))
    for v in x if isinstance(x, list) else [x]:
        yield (json.dumps(v, ensure_ascii=False),)


register(Handler("json", ("json",), ("application/json",), "row string", json_rows, lambda b: 1 if b.lstrip()[:1] in (b"{", b"[") else -1))


def yaml_value(text: str):
    """A YAML document of block and flow collections, scalars, literal and folded blocks, anchors and aliases; tags are skipped."""
    return _Yaml(text).document()


class _Yaml:
    def __init__(self, text: str):
        self.lines: list[tuple[int, str]] = []
        self.raw = text.split("\n")
        for line in self.raw:
            body = self._strip(line)
            self.lines.append((len(body) - len(body.lstrip(" ")), body.strip()))
        self.at = 0
        self.anchors: dict = {}

    @staticmethod
    def _strip(line: str) -> str:
        quote = ""
        for i, ch in enumerate(line):
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "'\"" and (i == 0 or line[i - 1] in " [{,:-"):
                quote = ch
            elif ch == "#" and (i == 0 or line[i - 1] in " \t"):
                return line[:i].rstrip()
        return line.rstrip()

    def _skip(self) -> None:
        while self.at < len(self.lines) and (not self.lines[self.at][1] or self.lines[self.at][1] in ("---", "...") or self.lines[self.at][1].startswith("%")):
            self.at += 1

    def document(self):
        self._skip()
        return self._block(self.lines[self.at][0]) if self.at < len(self.lines) else None

    def _block(self, indent: int):
        self._skip()
        if self.at >= len(self.lines) or self.lines[self.at][0] < indent:
            return None
        indent, text = self.lines[self.at]
        if text == "-" or text.startswith("- "):
            out = []
            while True:
                self._skip()
                if self.at >= len(self.lines) or self.lines[self.at][0] != indent or not (self.lines[self.at][1] + " ").startswith("- "):
                    return out
                rest = self.lines[self.at][1][1:]
                inner = indent + 1 + len(rest) - len(rest.lstrip(" "))
                rest = rest.strip()
                if not rest:
                    self.at += 1
                    out.append(self._block(indent + 1))
                elif self._key(rest) or (rest + " ").startswith("- "):
                    self.lines[self.at] = (inner, rest)
                    out.append(self._block(inner))
                else:
                    self.at += 1
                    out.append(self._node(rest, indent))
        if self._key(text):
            obj = {}
            while True:
                self._skip()
                if self.at >= len(self.lines) or self.lines[self.at][0] != indent:
                    return obj
                k = self._key(self.lines[self.at][1])
                if not k:
                    return obj
                self.at += 1
                value = self._node(k[1], indent) if k[1] else self._nested(indent)
                if k[0] == "<<" and isinstance(value, dict):
                    obj = {**value, **obj}
                else:
                    obj[self._scalar(k[0])] = value
        self.at += 1
        return self._node(text, indent - 1)

    def _nested(self, indent: int):
        self._skip()
        if self.at < len(self.lines):
            at, text = self.lines[self.at]
            if at > indent or (at == indent and (text + " ").startswith("- ")):
                return self._block(at)
        return None

    @staticmethod
    def _key(text: str) -> tuple[str, str] | None:
        m = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`][^#]*?|<<)\s*:(?:\s+(.*)|)$""", text, re.S)
        return (m[1], (m[2] or "").strip()) if m else None

    def _node(self, text: str, indent: int):
        if m := re.match(r"&(\S+)\s*(.*)$", text, re.S):
            value = self._node(m[2], indent) if m[2] else self._nested(indent)
            self.anchors[m[1]] = value
            return value
        if m := re.match(r"!\S*\s*(.*)$", text, re.S):
            return self._node(m[1], indent) if m[1] else self._nested(indent)
        if text.startswith("*"):
            return self.anchors.get(text[1:].strip())
        if re.match(r"[|>][-+0-9]*$", text):
            rows = []
            while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip(" ")) > indent):
                rows.append(self.raw[self.at])
                self.at += 1
            cut = min((len(r) - len(r.lstrip(" ")) for r in rows if r.strip()), default=0)
            rows = [r[cut:] for r in rows]
            while rows and not rows[-1].strip():
                rows.pop()
            body = "\n".join(rows) if text[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(rows))
            return body if "-" in text else body + "\n"
        if text[:1] in "[{" and text:
            while not self._closed(text) and self.at < len(self.lines):
                text += " " + self.lines[self.at][1]
                self.at += 1
            return self._flow(text, 0)[0]
        while self.at < len(self.lines) and self.lines[self.at][1] and self.lines[self.at][0] > max(indent, 0) and text[:1] not in "'\"" and not self._key(self.lines[self.at][1]):
            text += " " + self.lines[self.at][1]
            self.at += 1
        return self._scalar(text)

    @staticmethod
    def _closed(text: str) -> bool:
        bare = re.sub(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""", "", text)
        return bare.count("[") + bare.count("{") <= bare.count("]") + bare.count("}")

    def _flow(self, s: str, i: int):
        while i < len(s) and s[i] in " ,":
            i += 1
        if i < len(s) and s[i] in "[{":
            seq, close = s[i] == "[", "]" if s[i] == "[" else "}"
            out: list = []
            obj: dict = {}
            i += 1
            while True:
                while i < len(s) and s[i] in " ,":
                    i += 1
                if i >= len(s) or s[i] == close:
                    return (out if seq else obj), i + 1
                v, i = self._flow(s, i)
                while i < len(s) and s[i] == " ":
                    i += 1
                if not seq:
                    value = None
                    if i < len(s) and s[i] == ":":
                        value, i = self._flow(s, i + 1)
                    obj[v] = value
                else:
                    out.append(v)
        m = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^,\[\]{}:]|:(?! |$))*""").match(s, i)
        text = m[0].strip()
        return (self.anchors.get(text[1:]) if text.startswith("*") else self._scalar(text)), m.end()

    @staticmethod
    def _scalar(t: str):
        if t[:1] == '"':
            return json.loads(re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", t)) if t.endswith('"') and len(t) > 1 else t
        if t[:1] == "'":
            return t[1:-1].replace("''", "'")
        if t in ("", "~", "null", "Null", "NULL"):
            return None
        if t in ("true", "True", "TRUE", "false", "False", "FALSE"):
            return t.lower() == "true"
        if re.fullmatch(r"[-+]?\d+", t):
            return int(t)
        if re.fullmatch(r"0x[0-9a-fA-F]+|0o[0-7]+", t):
            return int(t, 0)
        if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", t):
            return float(t)
        return t


def yaml_rows(b: bytes) -> Iterator[tuple]:
    for part in re.split(r"(?m)^---(?:[ \t].*)?$", b.decode("utf-8-sig")):
        if part.strip():
            yield (_json(yaml_value(part)),)


register(Handler("yaml", ("yaml", "yml"), ("application/yaml", "text/yaml"), "row string", yaml_rows, lambda b: 1 if b.startswith((b"---", b"%YAML")) else 0))


def xml_rows(b: bytes) -> Iterator[tuple]:
    """Elements of an XML document in order: depth, path, name, attributes, own text."""
    depth, path = 0, []
    for event, e in ET.iterparse(io.BytesIO(b), events=("start", "end")):
        if event == "start":
            path.append(e.tag)
            e.set("\0", f"{depth}|{'/'.join(path)}")
            depth += 1
        else:
            depth -= 1
            path.pop()
    root = e
    for x in root.iter():
        level, _, where = x.attrib.pop("\0").partition("|")
        yield int(level), where, x.tag, _json(dict(x.attrib)), (x.text or "").strip() or None


register(Handler("xml", ("xml", "xsd", "svg", "kml", "gml"), ("application/xml", "text/xml"), "depth int, path string, name string, attributes string, text string", xml_rows, lambda b: 1 if b.lstrip()[:5] == b"<?xml" else -1))


def xsd_rows(b: bytes) -> Iterator[tuple]:
    """Declarations of an XML schema in order: depth, kind, name, type, least and most occurrences (null for unbounded), values of an enumeration.

    A reference has the name it refers to; a type that is declared on the spot is
    `complex` or `simple`, with the base that it extends or restricts behind a colon.
    """
    local = lambda tag: tag.rpartition("}")[2]

    def walk(e, depth: int) -> Iterator[tuple]:
        kind = local(e.tag)
        if kind in ("element", "attribute", "complexType", "simpleType", "group", "attributeGroup", "any"):
            own = next((local(x.tag)[:-4] for x in e if local(x.tag) in ("complexType", "simpleType")), None)
            base = next((x.get("base") for x in e.iter() if local(x.tag) in ("extension", "restriction") and x.get("base")), None)
            declared = e.get("type") or (f"{own}:{base}" if own and base else own) or (base if kind.endswith("Type") else None)
            most = e.get("maxOccurs", "1")
            least = int(e.get("minOccurs", "1")) if kind != "attribute" else int(e.get("use") == "required")
            values = [x.get("value") for x in e.iter() if local(x.tag) == "enumeration"] if kind == "simpleType" or own == "simple" else []
            yield depth, kind, e.get("name") or e.get("ref"), declared, least, None if most == "unbounded" else int(most), values
            depth += 1
        for x in e:
            yield from walk(x, depth)

    yield from walk(ET.fromstring(b), 0)


register(Handler("xsd", ("xsd",), ("application/xml-schema",), "depth int, kind string, name string, type string, least int, most int, values array<string>", xsd_rows))

#: FlatBuffers scalars: struct codes (fixed values).
FLAT = {"bool": "?", "byte": "b", "ubyte": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "long": "q", "ulong": "Q", "double": "d"}


def flatbuffer(b: bytes, fields: list[tuple[str, str | list]], at: int | None = None) -> dict:
    """A FlatBuffers table as a dictionary. fields are (name, type) in the order of their ids.

    A type is a scalar's name, `string`, a list of fields for a table inside, or
    `[type]` for a vector of any of these, with `[...]` as a one-element tuple for
    a vector of tables. Missing fields are None.
    """
    if at is None:
        at = struct.unpack_from("<I", b, 0)[0]
    table = at - struct.unpack_from("<i", b, at)[0]
    size = struct.unpack_from("<H", b, table)[0]

    def value(kind, place: int):
        if isinstance(kind, str) and kind in FLAT:
            return struct.unpack_from("<" + FLAT[kind], b, place)[0]
        place += struct.unpack_from("<I", b, place)[0]
        if kind == "string":
            n = struct.unpack_from("<I", b, place)[0]
            return b[place + 4 : place + 4 + n].decode()
        if isinstance(kind, list):
            return flatbuffer(b, kind, place)
        inner = kind[0] if isinstance(kind, tuple) else kind[1:-1]
        step = struct.calcsize("<" + FLAT[inner]) if isinstance(inner, str) and inner in FLAT else 4
        return [value(inner, place + 4 + step * k) for k in range(struct.unpack_from("<I", b, place)[0])]

    out = {}
    for k, (name, kind) in enumerate(fields):
        offset = struct.unpack_from("<H", b, table + 4 + 2 * k)[0] if 4 + 2 * k < size else 0
        out[name] = value(kind, at + offset) if offset else None
    return out


def flatbuffers(name: str, fields: list[tuple[str, str | list]]) -> Handler:
    """A handler of files that are one table of a schema each; the row is JSON."""
    return register(Handler(name, (), (), "row string", lambda b: iter([(_json(flatbuffer(b, fields)),)])))


def xlsx_rows(b: bytes) -> Iterator[tuple]:
    """Cells of a workbook: sheet, row and column from 0, type (number, text, boolean, error), number, text."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if tag(t) == "t"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        sheets = [(s.get("name"), next((v for k, v in s.attrib.items() if k.endswith("}id")), None)) for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if tag(s) == "sheet"]
        for i, (title, rid) in enumerate(sheets, 1):
            target = links.get(rid, f"worksheets/sheet{i}.xml").lstrip("/")
            target = target if target.startswith("xl/") else "xl/" + target
            row = -1
            for r in (e for e in ET.fromstring(z.read(target)).iter() if tag(e) == "row"):
                row = int(r.get("r")) - 1 if r.get("r") else row + 1
                col = -1
                for c in r:
                    if m := re.match(r"([A-Z]+)\d*$", c.get("r") or ""):
                        col = 0
                        for ch in m[1]:
                            col = col * 26 + ord(ch) - 64
                        col -= 1
                    else:
                        col += 1
                    v = next((x.text for x in c if tag(x) == "v"), None)
                    t = c.get("t", "n")
                    if t == "s" and v is not None:
                        yield title, row, col, "text", None, shared[int(v)]
                    elif t == "inlineStr":
                        yield title, row, col, "text", None, "".join(x.text or "" for x in c.iter() if tag(x) == "t")
                    elif v is not None:
                        kind = {"b": "boolean", "e": "error", "str": "text", "d": "text"}.get(t, "number")
                        yield title, row, col, kind, float(v) if kind in ("number", "boolean") else None, v


register(Handler("xlsx", ("xlsx", "xlsm"), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), "sheet string, row int, col int, type string, number double, text string", xlsx_rows, lambda b: 1 if b[:4] == b"PK\x03\x04" and b"xl/" in b else -2))


def ods_rows(b: bytes) -> Iterator[tuple]:
    """Cells of an OpenDocument sheet, in the form of xlsx_rows; repeated cells are given once for each place if they have a value."""
    tag = lambda e: e.tag.rpartition("}")[2]
    attr = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        root = ET.fromstring(z.read("content.xml"))
    for t in (e for e in root.iter() if tag(e) == "table"):
        row = 0
        for r in (e for e in t.iter() if tag(e) == "table-row"):
            times = int(attr(r, "number-rows-repeated") or 1)
            cells, col = [], 0
            for c in (e for e in r if tag(e) in ("table-cell", "covered-table-cell")):
                n = int(attr(c, "number-columns-repeated") or 1)
                kind = attr(c, "value-type")
                if kind:
                    text = "\n".join("".join(p.itertext()) for p in c if tag(p) == "p")
                    number = float(attr(c, "value")) if attr(c, "value") else float(attr(c, "boolean-value") == "true") if kind == "boolean" else None
                    cells += [(col + k, "text" if kind in ("string", "date", "time") else "boolean" if kind == "boolean" else "number", number, text) for k in range(n)]
                col += n
            if cells:
                for k in range(times):
                    for c in cells:
                        yield attr(t, "name"), row + k, *c
            row += times


register(Handler("ods", ("ods",), ("application/vnd.oasis.opendocument.spreadsheet",), "sheet string, row int, col int, type string, number double, text string", ods_rows, lambda b: 1 if b[:4] == b"PK\x03\x04" and b"opendocument.spreadsheet" in b[:200] else -2))

#: MATLAB element and array types (fixed values).
_MI = {1: "b", 2: "B", 3: "h", 4: "H", 5: "i", 6: "I", 7: "f", 9: "d", 12: "q", 13: "Q", 16: "B", 17: "H", 18: "I"}


def _mat_element(b: bytes, at: int, e: str) -> tuple[int, bytes, int]:
    kind, n = struct.unpack_from(e + "II", b, at)
    if kind >> 16:
        return kind & 0xFFFF, b[at + 4 : at + 4 + (kind >> 16)], at + 8
    return kind, b[at + 8 : at + 8 + n], at + 8 + n + (-n % 8 if kind != 15 else 0)


def _mat_numbers(kind: int, data: bytes, e: str) -> list:
    f = _MI[kind]
    return list(struct.unpack(f"{e}{len(data) // struct.calcsize(f)}{f}", data))


def _mat_array(b: bytes, e: str) -> tuple[str, dict]:
    _, flags, at = _mat_element(b, 0, e)
    word = struct.unpack_from(e + "I", flags)[0]
    cls, is_complex = word & 0xFF, bool(word & 0x800)
    k, data, at = _mat_element(b, at, e)
    dims = _mat_numbers(k, data, e)
    _, name, at = _mat_element(b, at, e)
    out: dict = {"dims": dims}
    count = 1
    for d in dims:
        count *= d
    if cls == 1:
        out["cells"] = []
        for _ in range(count):
            _, data, at = _mat_element(b, at, e)
            out["cells"].append(_mat_array(data, e)[1] if data else None)
    elif cls in (2, 3):
        if cls == 3:
            _, _cname, at = _mat_element(b, at, e)
        k, data, at = _mat_element(b, at, e)
        width = _mat_numbers(k, data, e)[0]
        _, data, at = _mat_element(b, at, e)
        fields = [data[i : i + width].split(b"\0")[0].decode() for i in range(0, len(data), width)]
        out["fields"] = [{} for _ in range(count)]
        for item in out["fields"]:
            for f in fields:
                _, data, at = _mat_element(b, at, e)
                item[f] = _mat_array(data, e)[1] if data else None
    else:
        if cls == 5:
            for part in ("i", "j"):
                k, data, at = _mat_element(b, at, e)
                out[part] = _mat_numbers(k, data, e)
        k, data, at = _mat_element(b, at, e)
        v = data.decode("utf-16-le" if e == "<" else "utf-16-be") if k in (4, 17) and cls == 4 else data.decode("utf-8") if k == 16 and cls == 4 else _mat_numbers(k, data, e)
        out["text" if isinstance(v, str) else "values"] = v
        if is_complex:
            k, data, at = _mat_element(b, at, e)
            out["imaginary"] = _mat_numbers(k, data, e)
    return name.decode(), out


def matlab_rows(b: bytes) -> Iterator[tuple]:
    """Variables of a level-5 MAT file: name and value as JSON, with dimensions; numbers by column."""
    e = "<" if b[126:128] == b"IM" else ">"
    at = 128
    while at + 8 <= len(b):
        kind, data, at = _mat_element(b, at, e)
        if kind == 15:
            kind, data, _ = _mat_element(zlib.decompress(data), 0, e)
        if kind == 14:
            name, value = _mat_array(data, e)
            yield name, _json(value)


register(Handler("matlab", ("mat",), ("application/x-matlab-data",), "name string, value string", matlab_rows, lambda b: 2 if b[:10] == b"MATLAB 5.0" else -2))


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        if x < 0x80:
            return out, at
        shift += 7


def protobuf_rows(b: bytes, path: str = "", depth: int = 0) -> Iterator[tuple]:
    """Fields of a message without its schema: path of field numbers, wire type, number, bytes; parts that read as messages are opened too."""
    at = 0
    while at < len(b):
        key, at = varint(b, at)
        field, wire = key >> 3, key & 7
        where = f"{path}/{field}"
        if wire == 0:
            v, at = varint(b, at)
            yield where, "varint", v if v < 1 << 63 else v - (1 << 64), None
        elif wire == 1:
            yield where, "fixed64", struct.unpack_from("<q", b, at)[0], None
            at += 8
        elif wire == 5:
            yield where, "fixed32", struct.unpack_from("<i", b, at)[0], None
            at += 4
        elif wire == 2:
            n, at = varint(b, at)
            part = b[at : at + n]
            if len(part) < n:
                raise ValueError("a field ends beyond the message")
            at += n
            yield where, "bytes", None, part
            if part and depth < 20:
                try:
                    inner = list(protobuf_rows(part, where, depth + 1))
                except (ValueError, IndexError, struct.error):
                    inner = []
                yield from inner
        else:
            raise ValueError(f"wire type {wire}")


register(Handler("protobuf", ("pb", "perfetto-trace"), ("application/x-protobuf",), "path string, wire string, number long, bytes binary", protobuf_rows))


def pcap_rows(b: bytes) -> Iterator[tuple]:
    """Packets of a capture: microseconds since 1970, captured and original length, bytes."""
    magic = b[:4]
    e = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    nano = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    at = 24
    while at + 16 <= len(b):
        sec, frac, n, whole = struct.unpack_from(e + "IIII", b, at)
        yield sec * 1_000_000 + (frac // 1000 if nano else frac), n, whole, b[at + 16 : at + 16 + n]
        at += 16 + n


register(Handler("pcap", ("pcap", "cap"), ("application/vnd.tcpdump.pcap",), "micros long, captured int, length int, bytes binary", pcap_rows, lambda b: 2 if b[:4] in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else -2))


def plist_rows(b: bytes) -> Iterator[tuple]:
    """A property list, binary or XML, as JSON."""
    yield (_json(plistlib.loads(b)),)


register(Handler("plist", ("plist",), ("application/x-plist",), "row string", plist_rows, lambda b: 2 if b[:6] == b"bplist" or b"<!DOCTYPE plist" in b[:300] else -2))


def gedcom_rows(b: bytes) -> Iterator[tuple]:
    """Lines of a genealogy file: level, id, tag, value, and the path of tags above."""
    path: list[str] = []
    for line in b.decode("utf-8-sig", "replace").splitlines():
        if m := re.match(r"\s*(\d+)\s+(?:(@[^@]+@)\s+)?(\S+)(?: (.*))?$", line):
            level = int(m[1])
            path = [*path[:level], m[3]]
            yield level, m[2], m[3], m[4], "/".join(path)


register(Handler("gedcom", ("ged",), ("text/vnd.familysearch.gedcom",), "level int, id string, tag string, value string, path string", gedcom_rows, lambda b: 2 if b.lstrip(b"\xef\xbb\xbf")[:6] == b"0 HEAD" else -2))


def zip_rows(b: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        for i in z.infolist():
            if not i.is_dir():
                yield i.filename, i.file_size, z.read(i)


def tar_rows(b: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(b)) as t:
        for m in t:
            if m.isfile():
                yield m.name, m.size, t.extractfile(m).read()


register(Handler("zip", ("zip", "jar", "apk", "docx"), ("application/zip",), "name string, size long, content binary", zip_rows, lambda b: 1 if b[:4] == b"PK\x03\x04" else -2))
register(Handler("tar", ("tar", "tgz"), ("application/x-tar",), "name string, size long, content binary", tar_rows, lambda b: 2 if b[257:262] == b"ustar" else -2))


def grid_rows(b: bytes) -> Iterator[tuple]:
    """Cells of an ASCII raster grid: row, column, value; cells without data are left out."""
    head: dict[str, float] = {}
    lines = iter(b.decode("ascii", "replace").splitlines())
    row = 0
    for line in lines:
        parts = line.split()
        if not parts:
            continue
        if parts[0][0].isalpha():
            head[parts[0].lower()] = float(parts[1])
            continue
        none = head.get("nodata_value", -2147483647.0)
        for col, v in enumerate(map(float, parts)):
            if v != none:
                yield row, col, v
        row += 1


register(Handler("grid", ("asc",), (), "row int, col int, value double", grid_rows, lambda b: 2 if b[:5].lower() == b"ncols" else -2))


def html_rows(b: bytes) -> Iterator[tuple]:
    """Elements of a page in order: depth, path, name, attributes, own text; end tags may be missing."""
    from html.parser import HTMLParser

    void = set("area base br col embed hr img input link meta source track wbr".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.rows: list[list] = []
            self.open: list[int] = []

        def handle_starttag(self, tag, attrs):
            path = "/".join([*[self.rows[i][2] for i in self.open], tag])
            self.rows.append([len(self.open), path, tag, json.dumps(dict(attrs), ensure_ascii=False), []])
            if tag not in void:
                self.open.append(len(self.rows) - 1)

        def handle_endtag(self, tag):
            for k in range(len(self.open) - 1, -1, -1):
                if self.rows[self.open[k]][2] == tag:
                    del self.open[k:]
                    return

        def handle_data(self, data):
            if self.open:
                self.rows[self.open[-1]][4].append(data)

    r = Reader()
    r.feed(b.decode("utf-8", "replace"))
    r.close()
    for depth, path, name, attrs, text in r.rows:
        yield depth, path, name, attrs, " ".join("".join(text).split()) or None


register(Handler("html", ("html", "htm"), ("text/html",), "depth int, path string, name string, attributes string, text string", html_rows, lambda b: 2 if b.lstrip()[:9].lower() in (b"<!doctype", b"<html>") else -1))


def shapes_with_attributes(spark, path: str):
    """Shapes of all .shp files at a path with the rows of the .dbf of the same name, i-th with i-th."""
    from pyspark.sql import functions as F

    from .files import read

    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    s = read(spark, path, "shapefile", glob="*.shp", with_path=True).withColumn("file", stem)
    d = read(spark, path, "dbf", glob="*.dbf", with_path=True).select(stem.alias("__f"), F.col("ord").alias("__o"), "row")
    return s.join(d, (F.col("file") == F.col("__f")) & (F.col("ord") == F.col("__o")), "left").drop("__f", "__o")
