"""Language ID by error-correcting output codes.

Every language gets a codeword; one linear classifier per bit of the codewords
reads hashed character n-grams and says on which side of its split of the
languages a text falls. Decoding is loss-weighted: the language with the least
total loss of the bit margins against its codeword wins, and the gap to the
next one says how clear the choice is.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_hash, keep_rows, map_arrow, texts

#: Most training rows for each language, those with the smallest hash of the id.
TRAIN_ROWS = 500
#: Most training rows together: with more than 40 languages each has an equal part.
ALL_ROWS = 20_000
#: Most languages of a model, for the driver's memory; more than that raise an error.
LANGUAGES = 2000
BUCKETS = 1 << 12
#: Score differences below this leave a text ambiguous.
AMBIGUOUS = 0.02
_BLOCK = 1 << 18
#: Losses held at once in decoding.
_LOSSES = 1 << 20


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low[0])
    return out


_TABLE: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, anything else as 0."""
    if not _TABLE:
        _TABLE.append(_letters())
    a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = _TABLE[0][np.minimum(a, 0xFFFF)]
    if len(a) and a.max() > 0xFFFF:
        high = np.flatnonzero(a > 0xFFFF)
        low[high] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in a[high].tolist()]
    return low


def ngrams(text: str) -> np.ndarray | None:
    """Hashed counts of 1-, 2- and 3-grams over letters and word edges, as square roots at unit length; None without a letter.

    Long texts go through in overlapping blocks, so memory stays bounded and no n-gram is lost.
    """
    total = np.zeros(BUCKETS, np.float64)
    seen = False
    low = codes(text)
    if not low.any():
        return None
    for at in range(0, len(low), _BLOCK):
        x = low[max(0, at - 2) : at + _BLOCK].astype(np.uint64)
        new = 0 if at == 0 else 2
        if at == 0:
            x = np.concatenate([np.zeros(1, np.uint64), x])
            new = 1
        if at + _BLOCK >= len(low):
            x = np.concatenate([x, np.zeros(1, np.uint64)])
        h1 = x * np.uint64(0x9E3779B97F4A7C15)
        h2 = x[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h1[1:]
        h3 = x[:-2] * np.uint64(0x165667B19E3779F9) + h2[1:] if len(x) > 2 else h2[:0]
        shift = np.uint64(64 - 12)
        one = x != 0
        keep1, keep2, keep3 = one.copy(), one[1:] | one[:-1], one[1:-1] if len(x) > 2 else one[:0]
        keep1[:new] = False
        keep2[: max(0, new - 1)] = False
        for h, k, salt in ((h1, keep1, 1), (h2, keep2, 2), (h3, keep3, 3)):
            z = h[k] + np.uint64(salt)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((z >> shift).astype(np.int64), minlength=BUCKETS)
        seen = True
    total = np.sqrt(total)
    return (total / np.linalg.norm(total)).astype(np.float32) if seen else None


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """Rows of +1 and -1, one per language: every split of up to six languages, else well separated random splits."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        cols = [c for r in range(1, k) for c in combinations(range(k), r) if 0 in c]
        m = -np.ones((k, len(cols)))
        for j, c in enumerate(cols):
            m[list(c), j] = 1
        return m
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (k, width))
        gram = m @ m.T
        np.fill_diagonal(gram, -width)
        if (abs(m.sum(0)) < k).all() and (best is None or gram.max() < best[0]):
            best = gram.max(), m
    assert best is not None
    return best[1]


@dataclass(frozen=True)
class Decoder:
    """Languages, their codewords, and a linear classifier for every bit."""

    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, its share of belief, and its lead over the next one."""
        margin = np.clip(x @ self.weight + self.bias, -20, 20)
        loss = np.zeros((len(x), len(self.code)))
        step = max(1, _LOSSES // max(1, self.code.size))
        for at in range(0, len(x), step):
            loss[at : at + step] = (np.logaddexp(0, -margin[at : at + step, None, :] * self.code[None]) * self.bit_weight).sum(2)
        z = np.exp(-(loss - loss.min(1, keepdims=True)))
        p = z / z.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        return best, p.max(1), top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 40, l2: float = 1e-5) -> Decoder:
    code = codewords(len(langs))
    target = code[y] if len(y) else np.zeros((0, code.shape[1]))
    counts = np.bincount(y, minlength=len(langs)) if len(y) else np.ones(len(langs))
    share = (1 / np.maximum(counts, 1))[y] if len(y) else np.zeros(0)  # languages count alike
    share = share / share.sum() if len(y) else share
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    rng = np.random.default_rng(3)
    g2, gb2 = np.full(w.shape, 1e-8, np.float32), np.full(b.shape, 1e-8)
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            k = order[at : at + 256]
            t = target[k]
            g = -t / (1 + np.exp(np.clip(t * (x[k] @ w + b), -50, 50))) * (share[k] * len(y) / len(k))[:, None]
            gw, gb = (x[k].T @ g).astype(np.float32) + l2 * w, g.sum(0)
            g2 += gw * gw
            gb2 += gb * gb
            w -= 0.5 * gw / np.sqrt(g2)
            b -= 0.1 * gb / np.sqrt(gb2)
    wrong = np.array([((np.sign(x @ w + b) != target)[:, j]).mean() for j in range(code.shape[1])]) if len(y) else np.zeros(code.shape[1])
    trust = np.clip(np.log((1 - wrong + 0.01) / (wrong + 0.01)), 0.1, None)
    return Decoder(langs, code, w, b, trust / trust.mean())


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Decoder:
    """Fit on at most TRAIN_ROWS documents for each language and ALL_ROWS in all, outside the held-out part.

    The languages are all non-null values of lang there; rows are those with
    the smallest hash of the id, and of repeated ones of a language the one with
    the least hash of its text. Rows without a letter are left out. Ids may be of
    any type; an empty table gives a decoder that knows no language.
    """
    part = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in part.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()}
    langs = sorted(counts)
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not langs:
        return fit(np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64), langs)
    most = min(TRAIN_ROWS, ALL_ROWS // len(langs))
    # the smallest hashes of each language: a share by its count leaves few ids to rank, however large the table
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, (2 * most + 200) / counts[g])))])
    few = part.where(by_hash(F.col("doc_id"), share[F.col("lang")])).select("lang", "doc_id").distinct()
    small = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("r") <= most).select(F.col("lang").alias("l"), "doc_id")
    rows = part.join(F.broadcast(small), ["doc_id"]).where(F.col("lang") == F.col("l"))  # ALL_ROWS ids at most
    rows = rows.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "lang", "t.text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [ngrams(t) for t in texts(b)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([None if v is None else v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["doc_id", "lang", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_arrow(rows, run, f"doc_id {kind}, lang string, x binary").where(F.col("x").isNotNull()).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    at = {s: k for k, s in enumerate(langs)}
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return fit(x, np.array([at[s] for s in got["lang"].to_pylist()], np.int64), langs)


def _decoded(model: Decoder, texts_: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    lang, score, lead = ["und"] * len(texts_), np.zeros(len(texts_)), np.zeros(len(texts_))
    if not model.langs:
        return lang, score, lead
    for start in range(0, len(texts_), 256):
        rows = [(k, v) for k in range(start, min(start + 256, len(texts_))) if (v := ngrams(texts_[k])) is not None]
        if rows:
            k = np.array([r[0] for r in rows])
            best, score[k], lead[k] = model.decode(np.stack([r[1] for r in rows]))
            for i, j in zip(k.tolist(), best.tolist(), strict=True):
                lang[i] = model.langs[j]
    return lang, score, lead


def predict_languages(docs: DataFrame, model: Decoder) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score, ambiguous.

    A null text, or one without letters, is `und` with score 0 and ambiguous.
    Only the text enters a prediction; repeated rows give repeated results and
    an empty table an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for the languages

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, lead = _decoded(sent.value, texts(b))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang), pa.array(score), pa.array(lead < AMBIGUOUS)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Decoder) -> DataFrame:
    """The documents whose language is known and not ambiguous, with all their columns: null texts and those without a letter go, repeated rows alike, an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def mask(b: pa.RecordBatch) -> pa.Array:
        return pc.greater_equal(pa.array(_decoded(sent.value, texts(b))[2]), AMBIGUOUS)

    return keep_rows(docs, mask)
