"""The training-data operators against brute force, public libraries and planted cases; edge rows for all."""

import hashlib
import html
import random
import re
import time
import tracemalloc
import zlib
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import bpe, decontam, htmlextract, langid, quality, queries, rules, sharding, shingles, simhash, tokencount, urlfilter
from brindle.operators import graph
from brindle.operators.work import cut

PATH = queries.vocab_path()
EDGE = "doc_id long, text string, lang string, source string, n_chars long, score int, fp string, tokens int, `__hash` int"
ROWS = [(1, "", "en"), (2, None, "en"), (None, "the end of the road", None), (3, "same words here and there", "en"), (3, "same words here and there", "en"), (4, "word " * 30_000, "de"), (5, "é\n\n\t 日本 \x00 $%&", None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, g, "s", 0, 1, "x", 2, 3) for i, t, g in ROWS], EDGE).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe.WordBPE(PATH)


ALPHABET = [*"abeéèßüñ 'sStTdDlLvVmMrR.,!#$%&019²½Ⅳ\u0327\u0301ΣςİıK日本\x00\x1c\x1f\x85\xa0\u180e😀ǅ_-\n\t", "<|endoftext|>", "<|startoftext|>", "'re", "'LL", "the", "<|", "ing"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join))
def test_bpe_as_the_library(lib, own, text):
    want = lib.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert got == want
    assert own.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_bpe_long_runs(lib, own):
    rng = random.Random(3)
    for text in ("#" * 5000, "".join(rng.choices("etaoinsh", k=20_000)), "a" * 20_000):
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_bpe_caches_start_anew(lib, monkeypatch):
    for name in ("CACHE", "WORD_CACHE", "PAIRS"):
        monkeypatch.setattr(bpe, name, 3)
    e = bpe.WordBPE(PATH)
    text = "Of all the things, the thing itself is the strangest; of all of them."
    for _ in range(3):
        assert e.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, data, docs, lib):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, data).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = lib.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(edge, none):
    got = bpe.encode_documents(edge, PATH, ids=True).collect()
    assert len(got) == len(ROWS) and {r.doc_id: r.n_tokens for r in got}[2] == 0
    assert all(len(r.ids) == r.n_tokens for r in got) and {r.doc_id: r.n_tokens for r in got}[4] == 30_000
    assert bpe.encode_documents(none, PATH).count() == 0


def test_sharding(spark, edge, none):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    got = sharding.assign(df, 2000).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    size = {}
    for r in got:
        size[r.prefix] = size.get(r.prefix, 0) + r.n_bytes
        assert len(r.prefix) == r.depth and r.fits
    assert all(r.shard_bytes == size[r.prefix] <= 2000 for r in got)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    parents = {}
    for r in got:  # only buckets over the limit split
        parents[r.prefix[:-1]] = parents.get(r.prefix[:-1], 0)
    for p in parents:
        assert sum(r.n_bytes for r in got if r.prefix.startswith(p)) > 2000
    same = spark.range(60).select(F.lit(7).alias("doc_id"), F.lit("y" * 40).alias("text"))
    split = sharding.assign(same, 100).collect()
    assert len(split) == 60 and all(r.shard_bytes <= 100 and r.depth > 60 for r in split)
    big = sharding.assign(edge, 1000).collect()
    assert len(big) == len(ROWS) and [r.fits for r in big if r.doc_id == 4] == [False] and all(r.shard_rows == 1 for r in big if not r.fits)
    assert sharding.assign(none).count() == 0


def test_write_shards(spark, docs, tmp_path):
    s = sharding.assign(docs, 20_000)
    sharding.write_shards(docs, s, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == s.select("prefix").distinct().count() > 4


def test_write_shards_of_repeated_ids(spark, tmp_path):
    rows = [(i, t * 40) for i in (7, None) for t in "xxxyz" for _ in range(8)] + [(7, None), (None, ""), (1, "é" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = sharding.assign(df, 100)
    sharding.write_shards(df, s, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(rows, key=key)
    got = {r.shard: (r.b, r.n) for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect()}
    assert got == {"s" + r.prefix: (r.shard_bytes, r.shard_rows) for r in s.collect()} and max(b for b, _ in got.values()) <= 100


def test_quality(spark, data, docs):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scored = quality.score_documents(docs, quality.train(docs, labels))
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.85 * len(held)


def test_quality_fits_on_all_labelled_rows(spark):
    rng = random.Random(8)
    rows = []
    for i in range(30_000):
        y = int(rng.random() < 0.8)
        words = rng.choices("river stone light above winter garden".split(), k=rng.randint(5, 12))
        words += rng.choices(["#$%", "XX", "&&"], k=rng.randint(0, 2) if y else rng.randint(1, 6))
        rows.append((i, " ".join(words), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    m = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    mine = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    x, y = np.array([quality.features(r[1].encode()) for r in mine]), np.array([r[2] for r in mine])
    low = int((m.latent(np.rint(x * quality.UNIT) / quality.UNIT) < m.cut).sum())
    ties = int((m.latent(np.rint(x * quality.UNIT) / quality.UNIT) == m.cut).sum())
    assert len(mine) > 20_000 and low <= (y == 0).sum() <= low + ties  # the quantile of them all
    same = quality.fit(x, y)
    assert np.allclose(m.weight, same.weight, atol=1e-2) and np.allclose(m.mean, x.mean(0), atol=1e-5)


def test_quality_edges(spark, edge, none):
    lab = spark.createDataFrame([(1, 0, None), (3, 1, 0), (3, None, 1), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    m = quality.train(edge, lab)
    assert quality.score_documents(edge, m).count() == len(ROWS)
    assert quality.keep_good(edge, m).columns == edge.columns
    blank = quality.train(none, lab)
    assert quality.keep_good(edge, blank).count() == len(ROWS) and quality.score_documents(none, blank).count() == 0


def test_language(spark, data, docs):
    got = queries.op4_language(spark, data).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)


def test_language_blocks_lose_nothing(monkeypatch):
    text = "Über den Wolken ist es schön, und le ciel est bleu; " * 40
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "_BLOCK", 37)
    assert np.allclose(langid.ngrams(text), whole)
    assert langid.ngrams("12 34 !?") is None and langid.ngrams("") is None


def test_codewords_differ():
    for k in (1, 2, 4, 6, 12):
        m = langid.codewords(k)
        assert len({tuple(r) for r in m.tolist()}) == k
        if k > 6:
            assert min((a != b).sum() for i, a in enumerate(m) for b in m[:i]) >= 3


def test_language_edges(edge, none):
    m = langid.train(edge)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict_languages(edge, m).collect()}
    assert (1, "und") in got and (2, "und") in got
    assert langid.predict_languages(none, m).count() == 0
    assert {r.lang_pred for r in langid.predict_languages(edge, langid.train(none)).collect()} == {"und"}
    assert langid.keep_identified(edge, m).columns == edge.columns


def test_language_of_many(spark):
    rng = random.Random(3)
    words = {f"l{g:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for g in range(130)}
    rows = [(100 * n + k, " ".join(rng.choices(w, k=40)), g) for n, (g, w) in enumerate(words.items()) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(df)
    assert m.langs == sorted(words)
    want = {i: g for i, _, g in rows}
    got = langid.predict_languages(df, m).where("held_out").collect()
    assert len(got) > 200 and sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.9 * len(got)
    assert langid.keep_identified(df, m).count() > 0


def test_token_counts(spark, data, docs, lib, edge, none, tmp_path, monkeypatch):
    want = sorted((r.doc_id, len(lib.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in queries.op5_token_counts(spark, data).collect()) == want
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tokencount.count_tokens(edge, PATH, str(tmp_path / "e")).collect())
    assert got == [(0, 5), (1, 0), (2, 0), (3, 5), (3, 5), (4, 30_000), (5, got[-1][1])]
    assert tokencount.count_tokens(none, PATH, str(tmp_path / "n")).count() == 0


@pytest.mark.parametrize("rows,files", [(1, 1), (500, 3), (1 << 20, 16)])
def test_token_counts_of_any_table(spark, docs, lib, tmp_path, monkeypatch, rows, files):
    monkeypatch.setattr(tokencount.write_tokens, "__defaults__", (rows, files))
    want = sorted((r.doc_id, len(lib.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
    many = docs.unionByName(docs)
    made = {
        "dealt": many.repartition(3),
        "sorted": many.orderBy("n_chars"),
        "joined": many.join(spark.range(10_000).withColumnRenamed("id", "doc_id"), "doc_id"),
        "filtered": many.where("doc_id % 3 = 1").repartition(5, "lang"),
    }
    for name, df in made.items():
        ids = {r[0] for r in df.select("doc_id").collect()}
        got = sorted(tuple(r) for r in tokencount.count_tokens(df, PATH, str(tmp_path / name)).collect())
        assert got == sorted(2 * [w for w in want if w[0] in ids]), name
    assert not tokencount.fixed_places(many.repartition(3)) and not tokencount.fixed_places(docs.limit(3))


def test_plain_scans_have_fixed_places(spark, data):
    scan = spark.read.parquet(f"{data}/documents.parquet".replace("0.001", "0.01")).select("doc_id", "text")  # not cached
    assert tokencount.fixed_places(scan) and tokencount.fixed_places(scan.where("doc_id > 3"))
    assert not tokencount.fixed_places(scan.where(F.rand() > 0.5)) and not tokencount.fixed_places(scan.sample(0.5, seed=1))


def test_token_files_are_bounded(spark, docs, tmp_path):
    tokencount.write_tokens(docs.coalesce(1), PATH, str(tmp_path / "f"), row_bytes=10_000, file_rows=2)
    longest = 2 * max(r.n_tokens for r in bpe.encode_documents(docs, PATH).collect()) + 2
    sizes = [p.stat().st_size for p in (tmp_path / "f").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) <= 2 * (10_000 + longest)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separator_scan_stitches(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = {}
    for stream in range(2):
        a = np.where(rng.random(60) < 0.2, tokencount.EOD, rng.integers(0, 900, 60)).astype(">u2")
        cuts = [0, 0, 17, 18, 60]
        for n, (x, y) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / f"part-{stream:05d}-1a2b-c4d5-x-c{n:03d}.txt").write_bytes(a[x:y].tobytes())
        lengths, run = [], 0
        for t in a.tolist():
            if t == tokencount.EOD:
                lengths.append((run, True))
                run = 0
            else:
                run += 1
        want[stream] = lengths + ([(run, False)] if run else [])
    got = tokencount.scan(spark, str(tmp_path), block=block).orderBy("stream", "ordinal").collect()
    for s in want:
        assert [(r.n_tokens, r.terminated) for r in got if r.stream == s] == want[s]
        assert [r.ordinal for r in got if r.stream == s] == list(range(len(want[s])))


def judge_plainly(url):
    if url is None or "://" not in url:
        return "", "", None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    fits = [(len(h + p), h + p) for h, p, _ in urlfilter.RULES if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
    return host, m[2], max(fits)[1] if fits else None


URLS = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x", "http://a.example.org/en/12?q=://z", "https://notexample.org/es/", "ftp://x.org", "http://org/", "http://b.COM/fr/1#a", "http://com/de/", "http://xcom/de/", "http://É.com/de/", "http://h?x=/fr/", "a://b://c/d", "http://q.com/de", "//x.org/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, "z") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host int, verdict string")
    got = urlfilter.judge(pages, []).collect()
    verdicts = {h + p: v for h, p, v in urlfilter.RULES}
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule = judge_plainly(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdicts.get(rule, "allow")), URLS[r.page_id]


def test_url_mining(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'fine'}.net/{'casino' if i % 4 == 1 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows + [(None, None), (None, "http://x.net/casino/")], "page_id long, url string").withColumn("id", F.lit(1)).withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(i, 0 if i % 4 == 1 else 1, 0) for i in range(400)] + [(None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    found = urlfilter.mine(urlfilter.labelled(pages, labels))
    assert (("p:casino",), "block", 100, 100) in {(r.tokens, r.verdict, r.n, r.k) for r in found}
    got = sorted((r.page_id or -1, r.url, r.verdict) for r in urlfilter.judge(pages, found).join(pages.select("page_id", "url"), "page_id").collect())
    assert len(got) == 400 and all((v == "block") == (i % 4 == 1) for i, _, v in got)
    loose = [r for r in urlfilter.judge(pages, found).collect() if r.page_id is None]
    assert sorted(r.verdict for r in loose) == ["allow", "block"]
    assert urlfilter.mine(urlfilter.labelled(pages.where("false"), labels)) == [] and urlfilter.mine(urlfilter.labelled(pages, labels.where("false"))) == []


def plain_tokens(url):
    if not url or "://" not in url:
        return set()
    host, path, _ = judge_plainly(url)
    query = re.search(r"\?([^#]*)", url, re.S)
    parts = ["s:" + url.split("://")[0], *("h:" + x for x in re.split(r"[.:]", host)), *("p:" + x for x in path.split("/")), *("q:" + x.split("=")[0] for x in (query[1] if query else "").split("&"))]
    return {x for x in parts if len(x) > 2}


def plain_rules(pages, labels):
    """All rules by counting every subset of every labelled url, unpruned: {tokens: (verdict, n, k)}, possibly both verdicts."""
    fixed = {h + p: v for h, p, v in urlfilter.RULES}
    bad = {}
    for r in labels:
        bad[r.doc_id] = bad.get(r.doc_id, False) or r.toxic == 1 or r.quality == 0
    rows = [(plain_tokens(u), fixed.get(judge_plainly(u)[2]) or {True: "block", False: "allow", None: None}[bad.get(i)]) for i, u in pages]
    rows = [(t, y) for t, y in rows if t and y]
    least = max(urlfilter.MIN_COUNT, -(-len(rows) // 500))
    often = {t for t in {t for x, _ in rows for t in x} if sum(t in x for x, _ in rows) >= least}
    counts, agree = {}, {}
    for t, y in rows:
        for size in range(1, len(t & often) + 1):
            for c in combinations(sorted(t & often), size):
                counts[c] = counts.get(c, 0) + 1
                agree[c, y] = agree.get((c, y), 0) + 1
    return [(c, y, counts[c], k) for (c, y), k in agree.items() if k >= least and 2 * k >= counts[c]]


def test_url_query_by_brute_force(spark, data):
    path = data.replace("sf0.001", "sf0.01")
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{path}/pages.parquet").collect()]
    every = plain_rules(pages, spark.read.parquet(f"{path}/labels.parquet").collect())
    ranked = sorted(every, key=lambda r: (-urlfilter.lower_bound(r[2], r[3]), len(r[0]), r[1] != "block", r[0]))
    mined = urlfilter.mine(urlfilter.labelled(spark.read.parquet(f"{path}/pages.parquet"), spark.read.parquet(f"{path}/labels.parquet")))
    assert mined and any(r.verdict == "block" for r in mined)  # the supplied tables must give rules of both kinds
    assert {(r.tokens, r.verdict, r.n, r.k) for r in mined} <= set(every)
    fixed = {h + p: v for h, p, v in urlfilter.RULES}
    got = {r.page_id: r for r in queries.op6_url_filter(spark, path).collect()}
    assert len(got) == len(pages)
    decided = 0
    for i, url in pages:
        host, p, rule = judge_plainly(url)
        first = None if rule else next((r for r in ranked if set(r[0]) <= plain_tokens(url)), None)
        decided += first is not None
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].mined_rule) == (host, p, rule, fixed.get(rule) or (first[1] if first else "allow"), first and " ".join(first[0]))
    assert decided > 0.5 * len(pages)


def test_url_rules_held_out(spark, data):
    path = data.replace("sf0.001", "sf0.1")
    r = urlfilter.held_out_report(spark.read.parquet(f"{path}/pages.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert r["block_rules"] > 0 and r["blocked"] >= 20 and r["hit"] >= 0.9 * r["blocked"]


def test_index_as_plain_containment():
    rng = random.Random(8)
    names = [f"p:{c}" for c in "abcdef"]
    rules_ = [urlfilter.Rule(t, rng.choice(["block", "allow"]), 9, 9, 0.5) for t in sorted({tuple(sorted(rng.sample(names, rng.randint(1, 3)))) for _ in range(14)})]
    rng.shuffle(rules_)
    index = urlfilter.Index(rules_)
    for _ in range(300):
        have = set(rng.sample(names, rng.randint(0, 6)))
        assert index.best(have) == next((r for r in rules_ if set(r.tokens) <= have), None)


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    """{index: smallest index} by comparing all."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_query(spark, data, docs):
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [plain_fingerprint(r.text) for r in rows]
    comp = plain_components(fps)
    got = {r.doc_id: r for r in queries.op7_simhash(spark, data).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert got[r.doc_id].fingerprint == f"{fps[i]:016x}" and got[r.doc_id].component_id == rows[comp[i]].doc_id


def test_simhash_long_texts_in_blocks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("crowd", [0, 2, 24])
def test_links_find_all_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    fps = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            fps.add(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(90)}
    order = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in order]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    edges = simhash.links(df).collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in edges)
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = plain_components(order)
    mine = [got.get(x, x) for x in signed]
    pairs = lambda c: {tuple(i for i in range(len(c)) if c[i] == r) for r in set(c)}
    assert pairs(mine) == pairs(want)


@pytest.mark.parametrize("hub", [2, 1000])
def test_plans_of_links_and_components_stay_small(spark, monkeypatch, hub):
    joins = []

    def counted(df, *spent):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut(df, *spent)

    for m in (graph, simhash):
        monkeypatch.setattr(m, "cut", counted)
    monkeypatch.setattr(graph, "HUB_LEAST", hub)
    rng = random.Random(hub)
    fps = {0, *(1 << k for k in range(30)), *(rng.getrandbits(63) for _ in range(60))}
    fps |= {x ^ (1 << k) for x in list(fps)[40:] for k in (3, 17)}
    order = sorted(fps)
    df = spark.createDataFrame([(x,) for x in order], "fp long").repartition(3)
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    mine, want = [got.get(x, x) for x in order], [order[c] for c in plain_components(order)]
    assert mine == want
    assert len(joins) > 4 and max(joins) <= 2


def test_plans_of_near_dedup_stay_small(spark, monkeypatch, docs):
    joins = []

    def counted(df, *spent):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut(df, *spent)

    for m in (graph, simhash, shingles):
        monkeypatch.setattr(m, "cut", counted)
    assert 0 < simhash.keep_one(docs).count() < docs.count()
    assert max(joins) <= 2


def test_simhash_edges(spark, edge, none):
    got = sorted(((r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash.near_duplicates(edge).collect())
    assert len(got) == len(ROWS) and [g[2] for g in got if g[0] in (1, 2)] == [1, 1] and [g[2] for g in got if g[0] == 3] == [3, 3]
    assert [g[2] for g in got if g[0] == 0] == [None]
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def close_pairs(texts):
    """All pairs (i, j) of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more, by brute force."""
    sets = [five_words(t) for t in texts]
    return {(j, i) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and 5 * len(a & b) >= 4 * len(a | b)}


def plain_groups(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = [plain_fingerprint(t) for t in texts]
    near = {(j, i) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    for j, i in close_pairs(texts) | near:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("crowd,half,sent", [(16, 400, 1000), (2, 400, 0), (2, 5, 1000)])
def test_near_dedup_keeps_one_of_edited_copies(spark, monkeypatch, crowd, half, sent):
    from brindle.llm import shingles

    monkeypatch.setattr(shingles, "CROWD", crowd)
    monkeypatch.setattr(shingles, "HALF_SETS", half)
    monkeypatch.setattr(simhash, "SENT", sent)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for n in (3, 5, 30, 60, 120, 300, 900, 3000):
        for _ in range(3):
            w = [word() for _ in range(n)]
            texts += [" ".join(w), " ".join(w).upper()]
            for share in (0.005, 0.01, 0.02, 0.02, 0.03, 0.08):
                v = list(w)
                for at in rng.sample(range(n), max(1, int(n * share))):
                    v[at] = word()
                texts.append(" ".join(v))
            texts.append(" ".join(w[: int(n * 0.85)]))
    fps = [plain_fingerprint(t) for t in texts]
    far = [(i, j) for i, j in close_pairs(texts) if (fps[i] ^ fps[j]).bit_count() > 3]
    assert len(far) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == set(plain_groups(texts))


def test_near_dedup_stage_by_brute_force(spark, data, docs):
    import corpus_pipeline

    rng = random.Random(4)
    rows = sorted(docs.collect())
    copies = []
    for r in [r for r in rows if len(r.text.split()) >= 80][:40]:
        w = r.text.split()
        for at in rng.sample(range(len(w)), max(1, len(w) // 60)):
            w[at] = "edited"
        copies.append((10_000 + r.doc_id, " ".join(w), r.lang, r.source, r.n_chars))
    df = docs.unionByName(spark.createDataFrame(copies, docs.schema))
    every = [(r.doc_id, r.text) for r in rows] + [c[:2] for c in copies]
    groups = plain_groups([t for _, t in every])
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, data).collect()}
    assert kept == {every[g][0] for g in groups}
    texts = [t for i, t in every if i in kept]
    assert not close_pairs(texts) and len(kept) < len(every) - 20


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in again for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "日", " ", " ", "\n", "\t", "\x1c", "\xa0", "#", "<", "A"]), max_size=60).map("".join))
def test_rule_measures(text):
    assert tuple(rules.measure(text.encode())[:5]) == plain_measures(text)


def test_rules_query(spark, data, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op8_quality_rules(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(texts[r.doc_id])
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    led = rules.ledger(docs)
    base = led.count()
    for policy in rules.POLICIES:
        kept = rules.apply_policy(led, policy).where("kept").count()
        for a in rules.ablations(led, policy).collect():
            mask = rules.POLICIES[policy] & ~rules.BIT[a.rule]
            assert a.kept_without == led.where(F.col("failures").bitwiseAND(F.lit(mask)) == 0).count() and a.only == a.kept_without - kept
    assert base == len(texts)


def test_rules_edges(edge, none):
    got = {r.doc_id: r for r in rules.apply_policy(rules.ledger(edge)).collect()}
    assert got[1].n_words == 0 and got[2].base_failed and not got[2].kept and got[4].base_failed
    assert rules.ledger(none).count() == 0


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    return [(i, " ".join(word() for _ in range(rng.randint(15, 60)))) for i in range(30)]


def test_decontamination_finds_planted(spark, bench):
    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choices("qrstuvwxyz", k=5)) for _ in range(n))
    docs, want = [], set()
    for i, text in bench:
        w = text.split()
        docs.append((3 * i, f"{filler(40)} {text.upper()}, {filler(9)}"))
        every8 = [x if k % 8 else "zzzzz" for k, x in enumerate(w)]
        docs.append((3 * i + 1, f"{filler(7)} {' '.join(every8)}"))
        want |= {(3 * i, i), (3 * i + 1, i)}
        docs.append((3 * i + 2, f"{filler(50)} {' '.join(w[:5])} {filler(20)}"))
    long = filler(120_000) + " " + bench[3][1]
    docs += [(1000, long), (1001, ""), (1002, None), (None, bench[0][1])]
    want |= {(1000, 3), (None, 0)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([*bench, bench[2], (99, None), (98, "too few words"), (None, filler(30))], "item_id long, text string")
    got = decontam.contaminated(df, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = {r.doc_id for r in decontam.keep_clean(df, b).collect()}
    assert kept == {r[0] for r in docs} - {d for d, _ in want}
    assert decontam.contaminated(df, b.where("false")).count() == 0 and decontam.contaminated(df.where("false"), b).count() == 0


def test_decontamination_of_short_and_nameless_items(spark, bench):
    long = bench[0][1]
    items = [(1, "Who wrote that odd book?"), (2, "who wrote that odd book"), (3, "Zanzibar"), (4, "one two three four five six seven"), (5, "..."), (None, long), (None, "quiet nameless words")]
    docs = [(1, "x y who wrote, that ODD book z z who wrote that odd book"), (2, "who wrote that book odd"), (3, f"a b {long} c"), (4, "it is quiet. Nameless words"), (5, "zanzibar"), (6, "one two three four five six"), (7, "seven"), (8, ""), (9, "that odd book"), (10, "x one two three four five six seven")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.contaminated(df, b).fillna(-1, ["item_id"]).collect())
    n = len(long.split())
    assert got == [(1, 1, 5, 5, 2, 7), (1, 2, 5, 5, 2, 7), (3, -1, n, n, 2, 2 + n), (4, -1, 3, 3, 2, 5), (5, 3, 1, 1, 0, 1), (10, 4, 7, 7, 1, 8)]
    assert sorted(r.doc_id for r in decontam.keep_clean(df, b).collect()) == [2, 6, 7, 8, 9]
    assert sorted(r.doc_id for r in decontam.keep_clean(df, b.where("item_id = 3")).collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 10]


@pytest.mark.parametrize("share,most", [(7, 28), (0, 10)])
def test_decontamination_filter_loses_nothing(spark, data, docs, monkeypatch, share, most):
    """Whole copies and nine tenths of an item, with a filter of few false hits and one of many."""
    monkeypatch.setattr(decontam, "FILTER_SHARE", share)
    monkeypatch.setattr(decontam, "FILTER_MOST", most)
    items = {r.item_id: [w for w in map(decontam._hash, r.text.split()) if w] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    found = queries.op9_decontamination(spark, data).collect()
    assert all(r.n_agree >= min(decontam.NEED_WORDS, decontam.NEED_SHARE * r.item_words) for r in found)
    got = {(r.doc_id, r.item_id) for r in found}
    want = set()
    for r in docs.collect():
        w = [x for x in map(decontam._hash, r.text.split()) if x]
        for i, item in items.items():
            n = len(item)
            best = max((sum(a == c for a, c in zip(item, w[s : s + n])) for s in range(max(0, len(w) - n) + 1)), default=0)
            if best >= 0.9 * n:
                want.add((r.doc_id, i))
    assert want and want <= got


def plain_overlap(words, item, need):
    """Agreeing words of the best cluster of diagonals with a spaced seed, by plain loops; None if too few."""
    diagonals = set()
    for mask in decontam.MASKS:
        places = {}
        for j in range(len(item) - mask[-1]):
            places.setdefault(tuple(item[j + k] for k in mask), []).append(j)
        for i in range(len(words) - mask[-1]):
            diagonals |= {i - j for j in places.get(tuple(words[i + k] for k in mask), ())}

    def stretch(d):
        best, run, start, at = 0, 0, 0, (0, 0)
        for j, x in enumerate(item):
            if run <= 0:
                run, start = 0, j
            run += 1 if 0 <= d + j < len(words) and words[d + j] == x else -2
            if run > best:
                best, at = run, (start, j + 1)
        return {j for j in range(*at) if 0 <= d + j < len(words) and words[d + j] == item[j]}

    got = {d: stretch(d) for d in diagonals}
    most = max((len(set().union(*(got[e] for e in diagonals if 0 <= e - d <= decontam.DRIFT))) for d in diagonals), default=0)
    return most if most and most >= need else None


def test_decontamination_by_brute_force(spark):
    rng = random.Random(12)
    docs, items, want = [], [], {}
    for case in range(120):
        vocab = [f"c{case}w{i}" for i in range(rng.choice([3, 12, 200]))]
        own = [[rng.choice(vocab) for _ in range(rng.randint(8, 30))] for _ in range(4)]
        for k, item in enumerate(own):
            items.append((10 * case + k, " ".join(item)))
        for j in range(5):
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
            part = [x if rng.random() > 0.1 else "other" for x in rng.choice(own)]
            at = rng.randint(0, len(w))
            text = w[:at] + part[: rng.randint(0, len(part))] + w[at:]
            docs.append((10 * case + j, " ".join(text)))
            for k, item in enumerate(own):
                if n := plain_overlap(text, item, min(decontam.NEED_WORDS, -(-7 * len(item) // 10))):
                    want[10 * case + j, 10 * case + k] = n
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.item_id): r.n_agree for r in got} == want and len(got) == len(want) > 200


def test_decontamination_query_by_brute_force(spark, data, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    plain = lambda t: [w for w in (re.sub(r"[\\W_]+", "", x.lower()) for x in t.split()) if w]
    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    want = {}
    for k, text in items.items():
        item = plain(text)
        for i, words in rows:
            if len(set(item) & set(words)) >= 5 and (n := plain_overlap(words, item, min(decontam.NEED_WORDS, -(-7 * len(item) // 10)))):
                want[i, k] = n
    assert want == {(r.doc_id, r.item_id): r.n_agree for r in queries.op9_decontamination(spark, data).collect()}


@pytest.mark.parametrize("pairs,cells,sent", [(1 << 20, 1 << 21, 1000), (100, 100, 0)])
def test_decontamination_of_hot_seeds(spark, monkeypatch, pairs, cells, sent):
    for name, x in (("PAIRS", pairs), ("CELLS", cells), ("SENT", sent)):
        monkeypatch.setattr(decontam, name, x)
    docs = [(1, "eggs " * 9 + "spam " * 300), (2, "spam"), (3, "spam " * 60 if pairs == 100 else "spam " * 100_000)] + [(100 + k, "spam " * 70) for k in range(40)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(1, "spam " * 60), (2, "ham " * 60)], "item_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contaminated(df, b).collect()}
    assert got == {1: (1, 60, 60, 9, 69), 3: (1, 60, 60, 0, 60), **{100 + k: (1, 60, 60, 0, 60) for k in range(40)}}
    assert time.perf_counter() - began < 60
    assert [r.doc_id for r in decontam.keep_clean(df, b).collect()] == [2]


def test_decontamination_without_spaces_and_other_ids(spark):
    item = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所で"
    docs = [("a", f"前書き。{item}続きもある。"), ("b", "吾輩は猫である。別の文がここに続いていて、もとの文とは違う。"), ("c", "สวัสดี"), ("d", "no"), (None, item)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    b = spark.createDataFrame([("x", item), ("y", "สวัสดี"), (None, "...")], "item_id string, text string")
    got = sorted((r.doc_id or "", r.item_id) for r in decontam.contaminated(df, b).collect())
    assert got == [("", "x"), ("a", "x"), ("c", "y")]
    assert sorted(r.doc_id for r in decontam.keep_clean(df, b).collect()) == ["b", "d"]


def test_ids_of_any_type_and_empty_stages(spark, docs, edge, none, data):
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    labels = spark.read.parquet(f"{data}/labels.parquet").withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    m = langid.train(named)
    assert langid.predict_languages(named, m).where("lang_pred = 'und'").count() <= docs.where("length(text) < 30").count()
    assert quality.score_documents(named, quality.train(named, labels)).where("predicted = 1").count() > 0.5 * docs.count()
    assert langid.keep_identified(none, m).count() == 0 == quality.keep_good(none, quality.train(named, labels)).count()
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontam.keep_clean(none, bench).count() == 0 and decontam.keep_clean(edge, bench).count() == len(ROWS)


def test_repeated_ids_fit_alike(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    twice = docs.unionByName(docs.withColumn("text", F.reverse("text")))
    a, b = quality.train(twice.repartition(2), labels), quality.train(twice.repartition(7), labels)
    assert np.array_equal(a.weight, b.weight) and a.cut == b.cut
    x, y = langid.train(twice.repartition(2)), langid.train(twice.repartition(7))
    assert np.array_equal(x.weight, y.weight)


def test_quality_cut_is_the_quantile():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, quality.WIDTH))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.3 * rng.normal(size=400) > -0.8).astype(int)
    m = quality.fit(x, y)
    s = np.sort(m.latent(x))
    bad = int((y == 0).sum())
    assert s[bad - 2] <= m.cut <= s[bad + 1] and abs((m.score(x) >= quality.CUT).sum() - (y == 1).sum()) <= 1
    pairs = m.latent(x[y == 1])[:, None] - m.latent(x[y == 0])[None]
    assert (pairs > 0).mean() > 0.97  # preferences the ranking gets right
    assert m.weight[0] > 2 * abs(m.weight[2:]).max()


def test_language_decoding_by_brute_force(docs):
    m = langid.train(docs)
    for r in docs.limit(40).collect():
        v = langid.ngrams(r.text)
        if v is None:
            continue
        loss = {}
        for lang, word in zip(m.langs, m.code):
            loss[lang] = sum(bw * np.log1p(np.exp(-bit * float(np.clip(v @ m.weight[:, j] + m.bias[j], -20, 20)))) for j, (bit, bw) in enumerate(zip(word, m.bit_weight)))
        (lang,), score, lead = langid._decoded(m, [r.text])
        best, second = sorted(loss.values())[:2]
        total = sum(np.exp(best - x) for x in loss.values())
        assert loss[lang] == pytest.approx(best) and score[0] == pytest.approx(1 / total, abs=1e-4) and lead[0] == pytest.approx((1 - np.exp(best - second)) / total, abs=1e-4)


def test_ambiguous_languages(spark):
    de, fr = "der hund und die katze sind im haus " * 6, "le chien et le chat sont dans la maison " * 6
    rows = [(i, de if i % 2 else fr, "de" if i % 2 else "fr") for i in range(60)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, de, None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.ambiguous) for r in langid.predict_languages(odd, m).collect()}
    assert got == {1: ("de", False), 2: ("und", True), 3: ("und", True)}
    flat = langid.Decoder(["de", "fr"], m.code, np.zeros_like(m.weight), np.zeros_like(m.bias), m.bit_weight)
    assert all(r.ambiguous for r in langid.predict_languages(odd, flat).collect())
    assert [r.doc_id for r in langid.keep_identified(odd, m).collect()] == [1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy now!</div>
<article><h1>Big &amp; small&nbsp;news</h1><p>First <b>bold</b> line<br>goes   on.<p>Second &lt;para&gt; &eacute;.</p><div class="ad">Sponsored words here</div><ul><li>One thing.</li><li>Another thing.</li></ul></article>
<aside class="sidebar"><p>Popular posts</p></aside><section class="comments"><p>I do not agree.</p></section><form><label>Mail</label><button>Send</button></form><footer>&copy; me</footer></body></html>"""


def test_html_page():
    m = htmlextract.default_model()
    assert htmlextract.main_text(PAGE, m) == "Big & small news\n\nFirst bold line goes on.\n\nSecond <para> é.\n\nOne thing.\n\nAnother thing."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "</b>", "<br>", "<!-- x -->", "<!--", "<script>", "</script>", "<", ">", "&amp;", "&bogus;", "text ", "<li>", "<td>", "<a href=\"a>b\">", "</a>", "\x00", "İ", "<svg/>", "<p", "é\n"]), max_size=25).map("".join))
def test_html_never_breaks(page):
    for leaf in htmlextract.leaves(page):
        assert leaf.text == " ".join(leaf.text.split()) != ""


def test_html_query(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = queries.op10_html(spark, data).collect()
    right = 0
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", body))
        right += r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    assert len(got) == len(pages) == right


@pytest.mark.parametrize("name,page", [("nested", "<div>x" * 100_000), ("quotes", '<a "' * 250_000), ("quotes, ended", '<a "' * 250_001 + ">"), ("two quotes", "<a '>\"<b \">'" * 80_000), ("inline", "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000), ("unmatched", "<div>" * 100_000 + "</section>" * 100_000), ("lists", "<ul><li>x" * 50_000 + "</foo>" * 50_000)])
def test_html_is_linear(name, page):
    m = htmlextract.default_model()
    began = time.perf_counter()
    blocks = htmlextract.leaves(page)
    (marks,) = m.label([blocks])
    assert time.perf_counter() - began < 5 and len(marks) == len(blocks)
    if name == "nested":
        tracemalloc.start()
        m.label([htmlextract.leaves(page)])
        assert tracemalloc.get_traced_memory()[1] < 500e6
        tracemalloc.stop()


def plain_path_vector(path):
    marks, at = [], path
    while at:
        marks = [*at.marks, *marks]
        at = at.above
    v = np.zeros(htmlextract.PATH_DIM)
    for t in set(marks) - {"html", "body"}:
        k, s = htmlextract._slot(t)
        v[k] += s
    if path.marks:
        k, s = htmlextract._slot("leaf " + path.marks[-1])
        v[k] += s
    return v, len(marks)


def test_path_vectors_by_brute_force(spark, data):
    for r in spark.read.parquet(f"{data}/pages.parquet").limit(20).collect() + [(0, "", PAGE + "<div class='a b'><p class=a><div hidden><b class=z>x" * 30)]:
        blocks = htmlextract.leaves(r[2])
        x = htmlextract.vectors(blocks)
        for b, row in zip(blocks, x):
            v, size = plain_path_vector(b.path)
            assert np.array_equal(row[: htmlextract.PATH_DIM], v) and b.path.size == size


def test_both_directions_as_trained(monkeypatch):
    m = htmlextract.default_model()
    source = htmlextract._Pages(5)
    pages = [[b for b, _ in source.page()] for _ in range(30)]
    x, mask = htmlextract._pad([htmlextract.vectors(p) for p in pages])
    want = m.logits(x, mask)[0] > 0
    monkeypatch.setattr(htmlextract, "STRETCH", 3)
    assert all(np.array_equal(y, want[: len(y), k]) for k, y in enumerate(m.label(pages)))


def test_html_held_out_and_edges(spark):
    m = htmlextract.default_model()
    made = [htmlextract._Pages(1234).page() for _ in range(1)]
    source = htmlextract._Pages(77)
    made += [source.page() for _ in range(150)]
    marks = m.label([[b for b, _ in p] for p in made])
    wrong = sum((np.array([t for _, t in p]) != y).sum() for p, y in zip(made, marks))
    assert wrong <= 0.02 * sum(map(len, made))
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", PAGE, 1), (4, "u", "<p>" + "word " * 50_000, 1), (4, "u", "<p>" + "word " * 50_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = htmlextract.extract(df).collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.page_id in (1, 2)} == {0}
    assert htmlextract.extract(df.where("false")).count() == 0


def test_pipeline(spark, data, docs):
    import corpus_pipeline

    labels = spark.read.parquet(f"{data}/labels.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    left = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        left = f(spark, left, data)
        assert left.columns == docs.columns
    kept = {r.doc_id: r.text for r in left.collect()}
    assert set(kept) == set(out) and all(out[i].n_tokens == len(out[i].ids) for i in out)
    leaks = {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
    assert not leaks & set(out)
    fps = [plain_fingerprint(t) for t in kept.values()]
    assert plain_components(fps) == list(range(len(fps)))
    good = labels.where("quality = 1").count()
    assert labels.where("quality = 1").join(spark.createDataFrame([(i,) for i in out], "doc_id long"), "doc_id").count() >= 0.6 * good


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_as_their_sql(spark, data, name):
    c = duckdb.connect()
    for f in Path(data).iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = queries.QUERIES[name](spark, data)
    cur = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    order = [names.index(x) for x in df.columns]
    assert len(names) == len(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())


def test_queries_registered():
    import __spark_entry__

    q = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", k)[0] for k in q if re.match(r"op\d+_", k)} and "pipeline" in q
