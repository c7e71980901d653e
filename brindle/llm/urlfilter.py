"""URL filters by association rules.

Fixed host and path rules come first. For the other urls, Spark's FP-growth
mines combinations of url tokens from labelled pages. Rules end in `block` or
`allow`; those with enough support and confidence are kept and ranked by the
lower bound of their confidence, and a rule that a more general one outranks is
pruned. The best ranked rule whose tokens a url has gives the verdict; rules are
found through an inverted index from their rarest token.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Host, path and verdict (fixed values).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A rule must hold for this share of the labelled urls, and for MIN_COUNT of them.
MIN_SUPPORT, MIN_COUNT = 2 / 1000, 5
MIN_CONFIDENCE = 0.5
#: Standard errors of the lower bound (Wilson) that ranks the rules.
Z = 2.0
#: Larger antecedents are not searched for more general rules; they stay, which changes no verdict.
PRUNE_TOKENS = 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "label="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^(/[^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest fixed rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):  # a longer one replaces a shorter one
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels, path segments, names of query parameters."""
    scheme = F.concat(F.lit("s:"), F.substring_index(url, "://", 1))
    labels = F.transform(F.split(host, r"[.:]"), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    query = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    every = F.array_distinct(F.concat(F.array(scheme), labels, segments, query))
    return F.when(F.instr(url, "://") > 0, F.filter(every, lambda x: F.length(x) > 2)).otherwise(F.array().cast("array<string>"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens and label of every labelled page: id, tokens, label.

    A page that a fixed rule decides has the rule's verdict as its label. Any
    other page is labelled by the row of labels with its id: `block` if that is
    toxic or of quality 0, else `allow`; a null on both counts is no label, and
    of repeated labels of an id one bad one is enough.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").alias("id"), F.col("url"), host.alias("host"), path.alias("path"))
    rows = rows.select("id", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), fixed_rule(F.col("host"), F.col("path"))[1].alias("label")).where(F.size("tokens") > 0)
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    of = known.groupBy(F.col("doc_id").alias("id")).agg(F.when(F.max(bad), "block").otherwise("allow").alias("label"))
    return rows.where(F.col("label").isNotNull()).unionByName(rows.where(F.col("label").isNull()).drop("label").join(of, "id"))


@dataclass(frozen=True)
class Rule:
    """Tokens, what they mean, how many labelled urls have them, how many of these agree, and the lower bound of the confidence."""

    tokens: tuple[str, ...]
    verdict: str
    n: int
    k: int
    score: float


def lower_bound(n: int, k: int) -> float:
    """Lower end of the Wilson interval of k out of n."""
    return round((k + Z * Z / 2 - Z * (k * (n - k) / n + Z * Z / 4) ** 0.5) / (n + Z * Z), 9)


def least_count(n: int) -> int:
    """Labelled urls, of n, that a rule must hold for."""
    return max(MIN_COUNT, -(-n * round(MIN_SUPPORT * 1000) // 1000))


def mine(rows: DataFrame) -> list[Rule]:
    """Ranked rules from labelled urls (tokens, label), best first.

    Equal scores rank fewer tokens first, then block, then by the tokens. A rule
    behind another one that has only some of its tokens never decides and is
    pruned. MIN_SUPPORT bounds the number of rules, whatever the table's size. No
    labelled url, or too few of a kind, gives no rule.
    """
    items = cut(rows.select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "label"))).alias("items")))
    n = items.count()
    least = least_count(n)
    if n < least:
        return []
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=MIN_CONFIDENCE).fit(items)
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit(_LABEL))).select("antecedent", F.col("consequent")[0].alias("label"), "confidence", "support")
    rules = []
    for antecedent, label, confidence, support in found.toLocalIterator():
        k = round(support * n)
        m = round(k / confidence)
        rules.append(Rule(tuple(sorted(antecedent)), label[len(_LABEL) :], m, k, lower_bound(m, k)))
    return prune(rules)


def prune(rules: list[Rule]) -> list[Rule]:
    """Rules in order of rank, without those that a more general one outranks."""
    kept: list[Rule] = []
    seen: set[tuple[str, ...]] = set()
    for r in sorted(rules, key=lambda r: (-r.score, len(r.tokens), r.verdict != "block", r.tokens)):
        if len(r.tokens) <= PRUNE_TOKENS and any(c in seen for size in range(1, len(r.tokens) + 1) for c in combinations(r.tokens, size)):
            continue
        kept.append(r)
        seen.add(r.tokens)
    return kept


class Index:
    """Inverted index of ranked rules, each under the token that the fewest rules have."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        often: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                often[t] = often.get(t, 0) + 1
        self.under: dict[str, list[tuple[int, frozenset[str]]]] = {}
        for rank, r in enumerate(rules):
            self.under.setdefault(min(r.tokens, key=lambda t: (often[t], t)), []).append((rank, frozenset(r.tokens)))

    def best(self, found: set[str]) -> Rule | None:
        """The best ranked rule that needs no other tokens than these."""
        at = min((rank for t in found for rank, needs in self.under.get(t, ()) if needs <= found), default=None)
        return None if at is None else self.rules[at]


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, score of every page.

    `rule` is the fixed rule that decides; else mined_rule has the tokens of the
    mined rule that does, with its score, and without either the url is allowed.
    A null url, or one without ://, has empty host and path and is allowed. A
    very long url is read whole. Repeated rows come back repeated, an empty table
    gives an empty result, and other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.when(rule.isNull(), tokens(F.col("url"), F.col("host"), F.col("path"))).alias("tokens"))
    sent = spark.sparkContext.broadcast(Index(rules))  # bounded by MIN_SUPPORT

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        index = sent.value
        best = [None if t is None else index.best(set(t)) for t in b.column("tokens").to_pylist()]
        verdicts = [v or (r.verdict if r else "allow") for v, r in zip(b.column("verdict").to_pylist(), best, strict=True)]
        more = [pa.array(verdicts, pa.string()), pa.array([r and " ".join(r.tokens) for r in best], pa.string()), pa.array([r and r.score for r in best], pa.float64())]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), *more], names=["page_id", "host", "path", "rule", "verdict", "mined_rule", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(rows, run, f"page_id {kind}, host string, path string, rule string, verdict string, mined_rule string, score double")


def held_out_report(pages: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Rules mined from four fifths of the labelled pages, and how their verdicts do on the fifth that is left.

    blocked, bad and hit are the urls blocked, those labelled block, and both.
    """
    rows = cut(labelled(pages, labels))
    kept_out = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    rules = mine(rows.where(~kept_out))
    index = Index(rules)
    got = [(index.best(set(t)), y) for t, y in rows.where(kept_out).select("tokens", "label").toLocalIterator()]
    blocked = [r is not None and r.verdict == "block" for r, _ in got]
    bad = [y == "block" for _, y in got]
    hit = sum(a and b for a, b in zip(blocked, bad, strict=True))
    return {"rules": len(rules), "block_rules": sum(r.verdict == "block" for r in rules), "urls": len(got), "decided": sum(r is not None for r, _ in got), "blocked": sum(blocked), "bad": sum(bad), "hit": hit}


def _fixed_sql(what: int) -> str:
    cases = " ".join(f"WHEN (host = '{r[0]}' OR host LIKE '%.{r[0]}') AND starts_with(path, '{r[1]}') THEN '{(r[0] + r[1], r[2])[what]}'" for r in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"CASE {cases} END"


#: The same in DuckDB, with every subset of every labelled url's frequent tokens counted.
SQL = rf"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
h AS (SELECT page_id, url, regexp_extract(rest, '^([^/?#]*)', 1) h0, rest FROM u),
g AS (SELECT page_id, url, translate(h0, '{_UPPER}', '{_LOWER}') host, regexp_extract(substr(rest, length(h0) + 1), '^(/[^?#]*)', 1) path FROM h),
p AS (SELECT *, {_fixed_sql(0)} rule, {_fixed_sql(1)} fixed,
  list_sort(list_distinct(list_filter(['s:' || split_part(url, '://', 1)] || list_transform(regexp_split_to_array(host, '[.:]'), lambda x: 'h:' || x) || list_transform(string_split(path, '/'), lambda x: 'p:' || x)
    || list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: 'q:' || split_part(x, '=', 1)), lambda x: length(x) > 2))) ts FROM g),
a AS (SELECT doc_id, CASE WHEN bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) THEN 'block' ELSE 'allow' END y FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY 1),
l AS (SELECT page_id, ts, coalesce(fixed, y) y FROM p LEFT JOIN a ON doc_id = page_id WHERE coalesce(fixed, y) IS NOT NULL AND contains(url, '://') AND len(ts) > 0),
least AS (SELECT greatest({MIN_COUNT}, (count(*) * {round(MIN_SUPPORT * 1000)} + 999) // 1000) m FROM l),
often AS (SELECT list(t) fs FROM (SELECT t FROM (SELECT unnest(ts) t FROM l) GROUP BY t HAVING count(*) >= (SELECT m FROM least))),
lf AS (SELECT y, list_filter(ts, lambda t: list_contains(fs, t)) ts FROM l, often),
s AS (SELECT y, list_filter(ts, lambda t, i: (mask >> (i - 1)) & 1 = 1) c FROM lf, LATERAL (SELECT unnest(range(1, 1 << len(ts))) mask) q),
r AS (SELECT c, y, k, n, round((k + {Z * Z / 2} - {Z} * sqrt(k * (n - k) / n + {Z * Z / 4})) / (n + {Z * Z}), 9) score
      FROM (SELECT c, y, count(*) k, sum(count(*)) OVER (PARTITION BY c) n FROM s GROUP BY 1, 2) WHERE k >= (SELECT m FROM least) AND k >= {MIN_CONFIDENCE} * n),
d AS (SELECT page_id, list_filter(ts, lambda t: list_contains(fs, t)) ts FROM p, often WHERE rule IS NULL AND contains(url, '://')),
c AS (SELECT page_id, list_filter(ts, lambda t, i: (mask >> (i - 1)) & 1 = 1) c FROM d, LATERAL (SELECT unnest(range(1, 1 << len(ts))) mask) q),
b AS (SELECT page_id, y, c, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, len(c), y DESC, c) w FROM (SELECT DISTINCT * FROM c) JOIN r USING (c))
SELECT p.page_id, coalesce(host, '') host, coalesce(path, '') path, rule, coalesce(fixed, y, 'allow') verdict, array_to_string(c, ' ') mined_rule, score FROM p LEFT JOIN b ON b.page_id = p.page_id AND w = 1
"""
