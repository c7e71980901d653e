"""File sources by handler: detection by name, MIME type or content, and parsing of whole files on the executors.

Files come through Spark's binaryFile reader, so any file system that Spark
reads will do; a parser turns one file's bytes into rows. A file is one task's
work, so very large inputs should be many files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = Callable[[bytes], Iterator[tuple]]


@dataclass(frozen=True)
class Handler:
    """A format: its name, extensions, MIME types, row schema, parser, and how sure it is about some bytes, from -2 to 2."""

    name: str
    extensions: tuple[str, ...]
    mime: tuple[str, ...]
    schema: str
    parse: Parser
    check: Callable[[bytes], int] = lambda b: 0


#: Bytes of small files whose rows are held together.
HELD_BYTES = 4_000_000

#: Rows of a file that is written: most formats are read and written as a whole in memory.
ROWS = 10_000

HANDLERS: dict[str, Handler] = {}


def register(h: Handler) -> Handler:
    HANDLERS[h.name] = h
    return h


def by_extension(path: str) -> list[Handler]:
    """Handlers of a path's extension, in order of registration."""
    ext = path.rpartition(".")[2].lower()
    return [h for h in HANDLERS.values() if ext in h.extensions]


def by_mime(mime: str) -> list[Handler]:
    return [h for h in HANDLERS.values() if mime.split(";")[0].strip().lower() in h.mime]


def identify(head: bytes) -> Handler | None:
    """The handler that is surest about the bytes; None if none is at all."""
    best = max(HANDLERS.values(), key=lambda h: h.check(head), default=None)
    return best if best and best.check(head) > 0 else None


def read(spark: SparkSession, path: str, handler: Handler | str, glob: str | None = None, recursive: bool = False, with_path: bool = False) -> DataFrame:
    """Rows of all files at a path, with an ordinal `ord` within each file, and its path as `file` on demand; files that cannot be parsed raise."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return parse_files(r.load(path).select("path", "content"), handler, with_path)


def _rows(batches: Iterator[pd.DataFrame], parse: Parser, names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of files, at most 5,000 at once; a frame costs more than a small file's rows, so that many files share one."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        for p, content in zip(b["path"], b["content"], strict=True):
            for at, row in enumerate(parse(bytes(content))):
                held.append((p, at, *row))
                if len(held) == 5000:
                    yield pd.DataFrame(held, columns=["file", "ord", *names], dtype="object")
                    held = []
            size += len(content)
            if held and size >= HELD_BYTES:
                yield pd.DataFrame(held, columns=["file", "ord", *names], dtype="object")
                held = []
            size = size if held else 0
    if held:
        yield pd.DataFrame(held, columns=["file", "ord", *names], dtype="object")


def parse_files(files: DataFrame, handler: Handler | str, with_path: bool = False) -> DataFrame:
    """Rows of files that a table holds as path and content, as read gives them."""
    h = HANDLERS[handler] if isinstance(handler, str) else handler
    names = [c.strip().split(" ")[0] for c in _fields(h.schema)]
    parse = h.parse

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows(batches, parse, names)

    out = files.mapInPandas(run, f"file string, ord long, {h.schema}")
    return out if with_path else out.drop("file")


def write(df: DataFrame, path: str, handler: str, rows: int = ROWS) -> None:
    """Write df as files of a format, each of at most so many rows of one partition, on any file system that Spark writes.

    Spark's text sink puts the bytes there: each file is one line, and the line
    separator is the byte that all files of the format end with.
    """
    from .writers import ENCODERS

    encode, end = ENCODERS[handler]
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def closed(held: list[dict]) -> pd.DataFrame:
            made = encode(held)
            if made[-1:] != end.encode():
                raise ValueError(f"a {handler} file ends with another byte")
            return pd.DataFrame({"value": [made[:-1]]})

        held: list[dict] = []
        for b in batches:
            for r in b.itertuples(index=False, name=None):
                held.append({n: _value(v) for n, v in zip(names, r, strict=True)})
                if len(held) == rows:
                    yield closed(held)
                    held = []
        if held:
            yield closed(held)

    files = df.mapInPandas(run, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", end).option("maxRecordsPerFile", 1).text(path)


def _value(v):
    """A plain Python value of a pandas one; NaN and the like are null."""
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") and getattr(v, "shape", None) == () else v.tolist() if hasattr(v, "tolist") else v


def _fields(schema: str) -> list[str]:
    """A schema text cut at its outer commas."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def find_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Paths, sizes and times of the files below a folder that fit a glob; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def write_listing(df: DataFrame, path: str) -> None:
    """Comma-separated values with a header."""
    df.write.option("header", True).csv(path)


def text_of(content: Column) -> Column:
    """Bytes as text, by their byte-order mark, UTF-8 without one."""
    head = lambda n: F.lower(F.hex(F.substring(content, 1, n)))
    rest = lambda n: F.substring(content, n + 1, 1 << 30)
    return F.when(head(3) == "efbbbf", F.decode(rest(3), "UTF-8")).when(head(2) == "fffe", F.decode(rest(2), "UTF-16LE")).when(head(2) == "feff", F.decode(rest(2), "UTF-16BE")).otherwise(F.decode(content, "UTF-8"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its text, by its byte-order mark, UTF-8 without one."""
    return spark.read.format("binaryFile").load(path).select("path", text_of(F.col("content")).alias("text"))


def convert_newlines(c, to: str = "\n"):
    """All kinds of line ends as one."""
    return F.regexp_replace(c, "\r\n|\r|\n", to)
