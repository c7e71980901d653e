"""Shared plumbing of the training-data operators: reading tables, shipping the package, work folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.work import cut, work_dir

__all__ = ["SLICE", "by_hash", "cut", "fixed_places", "keep_rows", "map_arrow", "raw", "ship", "table", "texts", "unused", "work_dir"]

#: Rows of a batch that are turned into Python objects at once.
SLICE = 400

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python workers can import it, and bound their batches.

    The archive is staged on the driver and served by Spark's own file server;
    executors never read the driver's folder. Spark's batches are bounded in rows
    alone, so where the session has the default of 10,000 it is set to 1,000 for
    good: plans read it when they run, which may be any time later.
    """
    if spark.conf.get(_BATCH) == "10000":  # the default: too many rows at once where texts are long
        spark.conf.set(_BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    stage = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, stage, True)
    out = Path(stage) / "brindle_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "brindle").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def fixed_places(docs: DataFrame) -> bool:
    """Whether docs is a scan of files, with projections and filters at most, so that every evaluation puts its rows at the same places."""
    left = [docs._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind not in ("Project", "Filter", "LogicalRelation") or not node.deterministic():
            return False
        below = node.children()
        if kind == "LogicalRelation" and node.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return False
        left += [below.apply(i) for i in range(below.size())]
    return True


def by_hash(doc_id: Column, share: Column | float) -> Column:
    """Whether a row is in a fixed share of all ids, chosen by their hash."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)) < F.lit(float(1 << 40)) * share


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, beginning with the given one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply f to slices of the Arrow batches; nothing is kept between them."""
    ship(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                yield f(b.slice(at, SLICE))

    return df.mapInArrow(over, schema)


def keep_rows(df: DataFrame, mask: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The rows of df for which mask is true, with all their columns unchanged."""
    ship(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield part.filter(mask(part))

    return df.mapInArrow(over, df.schema)
