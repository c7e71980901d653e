"""Token counts by scanning flat token files for their separators.

A stream of tokens lies in flat files of 16-bit big-endian ids, in order, with
an end-of-document id after each document and no index. Files are searched a
block at a time with numpy; a block reports how many tokens it has and where its
separators are. A prefix scan over a stream's blocks gives each block the number
of documents before it and the place of the last separator, which joins the
documents that reach across blocks and files.

Files are written by Spark's text sink, on any file system Spark can write: a
row holds the bytes of some documents, each with its separator, save the last
byte of all, and the line separator is that byte. Rows are bounded in tokens and
files in rows, so a file's size is bounded by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import SLICE, cut, fixed_places, ship, texts

#: The separator: no vocabulary that fits 16 bits here has this id, so no text can hold it. Its low byte ends a line.
EOD = 0xC10A
#: A row is closed once it has so many bytes, and a file once it has so many rows.
ROW_BYTES, FILE_ROWS = 1 << 17, 256
#: Tokens searched at once.
BLOCK = 1 << 20


def write_tokens(docs: DataFrame, vocab: str, path: str, row_bytes: int = ROW_BYTES, file_rows: int = FILE_ROWS) -> None:
    """Encode every whole text and write one stream of flat files for each partition, in the order of its rows. A null text is an empty document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocab)
        if len(e.shown) > EOD:
            raise ValueError("the vocabulary reaches the separator's id")
        end, row, size = EOD.to_bytes(2, "big"), [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(row)[:-1]], pa.binary())], names=["tokens"])

        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                for t in texts(b.slice(at, SLICE)):
                    ids = np.frombuffer(e.encode_bytes(t), e.dtype).astype(">u2").tobytes()
                    row += [ids, end]
                    size += len(ids) + 2
                    if size >= row_bytes:
                        yield closed()
                        row, size = [], 0
        if row:
            yield closed()

    rows = docs.select("text").mapInArrow(run, "tokens binary")
    rows.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", chr(EOD & 0xFF)).option("maxRecordsPerFile", file_rows).text(path)


def scan(spark: SparkSession, path: str, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """Count tokens of every document in flat files: stream, ordinal, n_tokens, terminated.

    A stream is the files that one task wrote, part-<stream>-...-c<number>, in
    order of the number. Tokens after a stream's last separator are a document
    with terminated false. No files give an empty result.
    """
    ship(spark)
    want = int(np.array([eod], ">u2").view(np.uint16)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, number, content in zip(b.column("stream"), b.column("number"), b.column("content"), strict=True):
                buf = content.as_buffer()
                if len(buf) % 2:
                    raise ValueError("a token file ends inside a token")
                a = np.frombuffer(buf, np.uint16)
                for k in range(0, len(a), block):
                    part = a[k : k + block]
                    at = np.flatnonzero(part == want).astype(np.int32)
                    cols = [pa.array([stream.as_py()], pa.int64()), pa.array([number.as_py()], pa.int64()), pa.array([k // block], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([at], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["stream", "number", "block", "n", "at"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(F.regexp_extract(name, r"^part-(\d+)-", 1).cast("long").alias("stream"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, r"-c(\d+)\.[^-]*$", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long").alias("number"), "content")
    found = files.mapInArrow(run, "stream long, number long, block long, n long, at array<int>")
    order = Window.partitionBy("stream").orderBy("number", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = F.when(F.size("at") > 0, F.col("base") + F.element_at("at", -1))
    placed = placed.withColumn("docs", F.coalesce(F.sum(F.size("at")).over(before), F.lit(0))).withColumn("last", F.coalesce(F.max(last).over(before), F.lit(-1)))
    placed = placed.withColumn("final", F.lead("block").over(order).isNull())
    ends = F.transform("at", lambda x: F.col("base") + x)
    starts = F.concat(F.array("last"), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    counts = F.zip_with(ends, starts, lambda e, s: F.struct((e - s - 1).alias("n_tokens"), F.lit(True).alias("terminated")))
    tail = F.col("base") + F.col("n") - 1 - F.greatest(F.col("last"), F.coalesce(last, F.lit(-1)))
    counts = F.when(F.col("final") & (tail > 0), F.concat(F.when(F.size("at") > 0, counts).otherwise(F.slice(counts, 1, 0)), F.array(F.struct(tail.alias("n_tokens"), F.lit(False).alias("terminated"))))).otherwise(F.when(F.size("at") > 0, counts).otherwise(F.slice(counts, 1, 0)))
    return placed.select("stream", "docs", F.posexplode(counts)).select("stream", (F.col("docs") + F.col("pos")).alias("ordinal"), "col.n_tokens", "col.terminated")


def count_tokens(docs: DataFrame, vocab: str, path: str) -> DataFrame:
    """Write the documents' flat files below path, scan them, and give each document its count: doc_id, n_tokens.

    The n-th document of stream k is the n-th row of partition k. A plain scan of
    files has the same rows there whenever it is read; anything else, such as a
    join, a sort or a repartitioned table, is written to a work table first. A
    count without a document, or the other way round, is an error. Null and empty
    texts count 0 tokens, a text of any length is one document; repeated rows come
    back repeated, an empty table gives an empty result, other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    if not fixed_places(docs):
        docs = cut(docs)
    write_tokens(docs, vocab, path)
    place = F.monotonically_increasing_id()
    rows = docs.select("doc_id", F.shiftright(place, 33).alias("stream"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"), F.lit(True).alias("there"))
    got = rows.join(scan(docs.sparkSession, path), ["stream", "ordinal"], "full_outer")
    checked = F.when(F.col("there").isNull() | F.col("n_tokens").isNull(), F.raise_error(F.lit("token files and documents differ"))).otherwise(F.col("n_tokens"))
    return got.select("doc_id", checked.cast("long").alias("n_tokens"))
