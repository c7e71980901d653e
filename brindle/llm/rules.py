"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document; the ledger keeps the measurements
and one bit for each rule that failed. Policies are versioned masks over these
bits, so applying one, or comparing what each rule alone removes, reads the
ledger and never the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw

SYMBOLS = b"#*$%&|<>"

#: Rules by bit: a name and the condition on the ledger's measurements under which a document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("shouting", "2 * n_upper_words > n_words"),
    ("long_word", "longest_word_bytes > 1000"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules that remove a document.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"

_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "longest_word_bytes"]


def measure(text: bytes) -> list[int]:
    """The measurements of one whole text in UTF-8, in the order of the ledger's columns."""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0, 0, 0]
    joined = b"".join(words)
    cont = np.frombuffer(joined, np.uint8)
    chars = len(joined) - int(((cont & 0xC0) == 0x80).sum())
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    upper = sum(map(bytes.isupper, words))  # with A-Z and without a-z
    return [n, chars, len(text) - len(text.translate(None, SYMBOLS)), duplicates, _repeated(words), lines, upper, max(map(len, words))]


def _repeated(words: list[bytes]) -> int:
    """Words inside a 3-word window that is found at least twice."""
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    number: dict[tuple, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in windows])
    hit = np.bincount(ids)[ids] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements, and `failures`, the bits of all failed rules.

    A null text counts as empty and has no words; a very long one is measured
    whole, in one task's memory. Repeated rows give repeated
    results, other columns are ignored, an empty table gives an empty ledger.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = np.array([measure(t) for t in raw(b)], np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(m[:, k]) for k in range(m.shape[1])]], names=["doc_id", *_LONGS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _LONGS))
    bits = [F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0)) for name, cond in RULES]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return got.withColumn("failures", failures.cast("long"))


def passes(policy: str = CURRENT) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    return rows.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", passes(policy))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, documents it alone removes, and documents kept without it."""
    mask = POLICIES[policy]
    failed = F.col("failures").bitwiseAND(F.lit(mask))
    used = [(n, b) for n, b in BIT.items() if b & mask]
    sums = rows.agg(*[F.count_if(failed.bitwiseAND(F.lit(b)) != 0).alias(f"f_{n}") for n, b in used], *[F.count_if(failed == b).alias(f"o_{n}") for n, b in used], F.count_if(failed == 0).alias("kept"))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"o_{n}").alias("only"), (F.col("kept") + F.col(f"o_{n}")).alias("kept_without")) for n, _ in used])).alias("x")).select("x.*")


def sql(policy: str = CURRENT) -> str:
    """The ledger under a policy in DuckDB, for tables whose doc_ids are unique."""
    conditions = " | ".join(f"CASE WHEN {cond} THEN {BIT[name]} ELSE 0 END" for name, cond in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) i, unnest(ws) w FROM d),
v AS (SELECT *, lead(w, 1) OVER o w1, lead(w, 2) OVER o w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) n FROM v WHERE w2 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) k) WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d),
g AS (SELECT doc_id, x, count(*) n FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
m AS (SELECT doc_id, sum(n)::BIGINT n_lines, sum(n - 1)::BIGINT n_dup_lines FROM g GROUP BY 1),
a AS (SELECT doc_id, len(ws)::BIGINT n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT n_repeat_words, coalesce(n_lines, 0)::BIGINT n_lines,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT n_upper_words, coalesce(list_max(list_transform(ws, lambda x: octet_length(encode(x)))), 0)::BIGINT longest_word_bytes
  FROM d LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT * EXCLUDE (f), f::BIGINT failures, f & {BASE} <> 0 base_failed, f & {POLICIES[policy]} = 0 kept FROM (SELECT *, ({conditions}) f FROM a)
"""
