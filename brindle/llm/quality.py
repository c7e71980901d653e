"""Quality classifier: Bradley-Terry ranking of documents by pairwise preferences.

Every pair of a good and a bad labelled document is a preference. The model
P(a preferred to b) = sigmoid(w . (f(a) - f(b))) is fitted by logistic loss on
feature differences, so w . f(x) ranks documents on one scale. The threshold is
a quantile of the fitted scores, the share of bad documents among the labels,
and the reported score is a logistic of the distance to that quantile.

All labelled rows take part, in all their pairs: a Newton step needs only counts
and sums of features by narrow bins of the score, which Spark adds up, so the
driver gets a bounded number of rows whatever the tables' size. The quantile is an
order statistic found by counting bins within bins. Features and weights are
fixed-point numbers, so sums and ties are exact, however rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_rows, map_arrow, raw, ship

CUT = 0.7
#: Fixed-point units of features, of standardised features and of weights.
UNIT, UNIT_Z, UNIT_W = 1 << 20, 1 << 16, 1 << 16
#: Bins of the score, PER_ONE in each unit, the outer ones open; squares are kept by bins COARSE times as wide.
BINS, PER_ONE, COARSE = 1024, 32, 8
ROUNDS = 40
#: Rows that a task sums up at once.
TOGETHER = 20_000

_CLASSES = [b"#*$%&|<>", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"()[]{}\"'", b"@/\\_=+~^`-"]


def _class_table() -> np.ndarray:
    t = np.zeros((256, len(_CLASSES) + 2), np.float32)
    for k, chars in enumerate(_CLASSES):
        t[list(chars), k] = 1
    t[[9, 10, 11, 12, 13, 32], len(_CLASSES)] = 1
    t[128:192, len(_CLASSES) + 1] = 1  # continuation bytes
    return t


_TABLE = _class_table()


def features(text: bytes) -> np.ndarray:
    """Feature vector of one whole text in UTF-8: character classes, word shapes, repetition of words, lines and triples."""
    data = np.frombuffer(text, np.uint8)
    per = np.zeros(_TABLE.shape[1], np.float64)
    for at in range(0, len(data), 1 << 20):
        per += np.bincount(data[at : at + (1 << 20)], minlength=256) @ _TABLE
    chars = max(1.0, len(data) - per[-1])
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words))
    triples = len(set(zip(words, words[1:], words[2:])))
    upper = sum(map(bytes.isupper, words))
    rate = per[: len(_CLASSES)] / chars
    m = max(1, n)
    return np.array(
        [
            *np.sqrt(rate), *(rate > 0.02), per[len(_CLASSES)] / chars, np.log1p(n), distinct / m if n else 1.0, 1 - triples / max(1, n - 2) if n > 2 else 0.0,
            1 - len(set(lines)) / max(1, len(lines)), upper / m, chars / m / 10, float(n < 5), float(distinct < 0.35 * n), float(n > 2 and triples < 0.7 * (n - 2)), float(upper > 0.3 * m),
        ],
        np.float64,
    )


WIDTH = len(features(b"x"))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features in units of UNIT_Z."""
    return np.rint(np.clip((x - mean) / scale, -8, 8) * UNIT_Z).astype(np.int64)


@dataclass(frozen=True)
class Ranker:
    """A fitted ranking: standardised weights, and the latent score at the chosen quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def fixed(self, x: np.ndarray) -> np.ndarray:
        """The latent score as a whole number, the same in whatever batch a row comes."""
        return _standard(x, self.mean, self.scale) @ np.rint(self.weight * UNIT_W).astype(np.int64)

    def latent(self, x: np.ndarray) -> np.ndarray:
        return self.fixed(x) / (UNIT_Z * UNIT_W)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the latent score; CUT exactly at the quantile."""
        z = self.latent(x) - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sums(x: np.ndarray, y: np.ndarray, m: Ranker) -> np.ndarray:
    """Rows (bin, feature or -1, n, sums): for each label and bin count and sum of features, for each wider bin their products with each feature."""
    z = _standard(x, m.mean, m.scale)
    s = z @ np.rint(m.weight * UNIT_W).astype(np.int64)
    at = np.clip((s * PER_ONE) // (UNIT_Z * UNIT_W) + BINS // 2, 0, BINS - 1) + BINS * y.astype(np.int64)
    order = np.argsort(at, kind="stable")
    z, at = z[order], at[order]
    out = []
    first = np.flatnonzero(np.diff(at, prepend=-1))
    n = np.diff(first, append=len(at))
    out.append(np.column_stack([at[first], np.full(len(first), -1), n, np.add.reduceat(z, first, axis=0)]))
    wide = at // COARSE
    first = np.flatnonzero(np.diff(wide, prepend=-1))
    for i, j in zip(first, [*first[1:], len(at)]):
        zz = np.zeros((WIDTH, WIDTH), np.int64)
        for k in range(i, j, 4096):  # products of so many rows are exact in floats
            part = z[k : min(j, k + 4096)].astype(np.float64)
            zz += (part.T @ part).astype(np.int64)
        out.append(np.column_stack([np.full(WIDTH, wide[i]), np.arange(WIDTH), np.full(WIDTH, j - i), zz]))
    return np.concatenate(out)


def _ranges(x: np.ndarray, m: Ranker, lo: int, hi: int) -> np.ndarray:
    """Rows (bin, n, least, greatest) of the latent scores from lo to hi, in BINS bins."""
    s = m.fixed(x)
    s = np.sort(s[(s >= lo) & (s <= hi)])
    at = (s - lo) // ((hi - lo) // BINS + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(s)) - 1
    return np.column_stack([at[first], last - first + 1, s[first], s[last]]) if len(s) else np.zeros((0, 4), np.int64)


def _newton(got: np.ndarray, w: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs of a good and a bad row, its gradient, and its curvature, from the rows of _sums."""
    n, f, zz = np.zeros((2, BINS)), np.zeros((2, BINS, WIDTH)), np.zeros((2, BINS // COARSE, WIDTH, WIDTH))
    fine = got[:, 1] < 0
    y, at = np.divmod(got[fine, 0], BINS)
    n[y, at], f[y, at] = got[fine, 2], got[fine, 3:] / UNIT_Z
    y, at = np.divmod(got[~fine, 0], BINS // COARSE)
    zz[y, at, got[~fine, 1]] = got[~fine, 3:] / UNIT_Z**2
    mean = (f @ w) / np.maximum(n, 1)  # of a bin's scores
    gap = np.clip(mean[1][:, None] - mean[0][None], -500, 500)
    p = 1 / (1 + np.exp(gap))
    pairs = n[1].sum() * n[0].sum()
    loss = n[1] @ np.logaddexp(0, -gap) @ n[0] / pairs + l2 / 2 * w @ w
    grad = -(f[1].T @ (p @ n[0]) - f[0].T @ (p.T @ n[1])) / pairs + l2 * w
    c = p * (1 - p)
    curve = -(f[1].T @ c @ f[0])
    curve += curve.T
    for k, a in ((1, c @ n[0]), (0, c.T @ n[1])):
        a, b = (v.reshape(-1, COARSE).sum(1) for v in (a * n[k], n[k]))
        curve += np.tensordot(a / np.maximum(b, 1), zz[k], 1)
    e, v = np.linalg.eigh(curve / pairs)
    return float(loss), grad, (v * (np.maximum(e, 0) + l2)) @ v.T


def _solve(m: Ranker, bad: int, total: int, sums: Callable[[Ranker], np.ndarray], ranges: Callable[[Ranker, int, int], np.ndarray], l2: float) -> Ranker:
    """Weights by Newton steps, halved while the loss rises, and the cut at the quantile."""
    best = None
    step = np.zeros(WIDTH)
    w = m.weight
    for _ in range(ROUNDS):
        now = _newton(sums(Ranker(m.mean, m.scale, w, 0.0)), w, l2)
        if best is not None and now[0] > best[1][0] + 1e-12:
            step = step / 2
        else:
            done = best is not None and best[1][0] - now[0] < 1e-7
            best, step = (w, now), -np.linalg.solve(now[2], now[1])
            if done:
                break
        if np.abs(step).max() < 1e-4:
            break
        w = np.rint((best[0] + step) * UNIT_W) / UNIT_W
    m = Ranker(m.mean, m.scale, best[0], 0.0)

    def ranked(k: int) -> int:
        lo, hi = (int(v) * int(np.rint(np.abs(best[0]) * UNIT_W).sum() * 8 * UNIT_Z + 1) for v in (-1, 1))
        while lo < hi:
            got = ranges(m, lo, hi)
            got = got[np.argsort(got[:, 0])]
            upto = np.cumsum(got[:, 1])
            i = int(np.searchsorted(upto, k, side="right"))
            k -= int(upto[i] - got[i, 1])
            lo, hi = int(got[i, 2]), int(got[i, 3])
        return lo

    low, rest = divmod(bad * (total - 1), total)
    a = ranked(low)
    return Ranker(m.mean, m.scale, best[0], (a + (ranked(low + 1) if rest else a)) / 2 / (UNIT_Z * UNIT_W))


def _flat() -> Ranker:
    return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), -1.0)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> Ranker:
    """Fit on feature rows and 0/1 labels held in memory, as train does on tables. With labels of one kind, or none, every document scores above the cut; a score that ties with the quantile is above it."""
    bad = int((y == 0).sum())
    if not 0 < bad < len(x):
        return _flat()
    m = Ranker(x.mean(0), np.maximum(x.std(0), 1e-3), np.zeros(WIDTH), 0.0)
    return _solve(m, bad, len(x), lambda r: _sums(x, y, r), lambda r, lo, hi: _ranges(x, r, lo, hi), l2)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, l2: float = 1e-3) -> Ranker:
    """Fit on all labelled documents outside the held-out part.

    Null labels, ids and texts are left out; of repeated labels of an id the
    least counts, and of repeated documents the one with the least hash of its
    text. Ids may be of any type; an empty table gives a ranking that keeps
    everything. Texts stay where they are: their features are joined with the
    labels and written as a work table, which every step reads once.
    """
    spark = docs.sparkSession
    ship(spark)
    lab = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in raw(b)])
        x = np.rint(np.minimum(x, 1 << 16) * UNIT).astype(np.int64).tolist()
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(x, pa.list_(pa.int64()))], names=["doc_id", "h", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    mine = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = map_arrow(mine, run, f"doc_id {kind}, h long, x array<long>").join(lab.hint("merge"), "doc_id")
    rows = cut(rows.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "x")).alias("t")).select("quality", "t.x"))
    wide = [F.col("x")[k].cast("decimal(19,0)") for k in range(WIDTH)]
    got = rows.agg(F.count("*"), F.sum(1 - F.col("quality")), *[F.sum(c) for c in wide], *[F.sum(c * c) for c in wide]).first()
    total, bad = got[0], got[1]
    if not total or not 0 < bad < total:
        return _flat()
    one, two = ([int(v) for v in got[at : at + WIDTH]] for at in (2, 2 + WIDTH))
    mean = np.array([a / total for a in one]) / UNIT
    scale = np.maximum(np.sqrt([(b * total - a * a) / total**2 for a, b in zip(one, two)]) / UNIT, 1e-3)

    def gather(f: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str], by: list[str], how: list) -> np.ndarray:
        def summed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            x = np.concatenate([b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH) for b in some]) / UNIT
            t = f(x, np.concatenate([b.column("quality").to_numpy(zero_copy_only=False) for b in some]))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in t.T], names=names)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some: list[pa.RecordBatch] = []
            for b in batches:
                some += [b] * (b.num_rows > 0)
                if sum(x.num_rows for x in some) >= TOGETHER:
                    yield summed(some)
                    some = []
            if some:
                yield summed(some)

        t = rows.mapInArrow(over, ", ".join(f"{c} long" for c in names)).groupBy(*by).agg(*how).toArrow()
        return np.column_stack([t[c].to_numpy() for c in names]) if t.num_rows else np.zeros((0, len(names)), np.int64)

    def sums(r: Ranker) -> np.ndarray:
        cols = ["n", *[f"f{k}" for k in range(WIDTH)]]
        return gather(lambda x, y: _sums(x, y, r), ["at", "k", *cols], ["at", "k"], [F.sum(c).alias(c) for c in cols])

    def ranges(r: Ranker, lo: int, hi: int) -> np.ndarray:
        return gather(lambda x, _: _ranges(x, r, lo, hi), ["at", "n", "a", "b"], ["at"], [F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")])

    return _solve(Ranker(mean, scale, np.zeros(WIDTH), 0.0), bad, total, sums, ranges, l2)


def score_documents(docs: DataFrame, model: Ranker) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    Only the text enters a score. A null text counts as empty; empty and very
    long texts are scored like any other. Other columns of docs are ignored,
    repeated rows give repeated results, an empty table an empty result.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([features(t) for t in raw(b)]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Ranker) -> DataFrame:
    """The documents with a score of at least CUT, with all their columns: null texts are judged as empty ones, repeated rows alike, an empty table stays empty."""

    def mask(b: pa.RecordBatch) -> pa.Array:
        return pc.greater_equal(pa.array(model.score(np.array([features(t) for t in raw(b)]))), CUT)

    return keep_rows(docs, mask)
