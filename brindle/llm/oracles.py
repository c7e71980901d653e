"""The results of some training-data queries in DuckDB, for the supplied tables: unique ids, no nulls."""

from __future__ import annotations

from . import decontam, simhash

#: The article of each page, a block for each paragraph and heading; the supplied pages mark their main text with one <article>.
HTML = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?p>|</?h1>') parts FROM pages),
b AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) t FROM a)
SELECT page_id, url, coalesce(t, '') "text", length(coalesce(t, ''))::BIGINT n_chars FROM b
"""


def _seeds(words: str, n: str) -> str:
    """Rows (pos, seed) of the windows of a list of words under every mask."""
    return " UNION ALL ".join(f"SELECT {k} mask, pos, {' || chr(32) || '.join(f'{words}[pos + {o + 1}]' for o in mask)} seed FROM (SELECT unnest(range(0, greatest(0, {n} - {mask[-1]}))) pos)" for k, mask in enumerate(decontam.MASKS))


_WORDS = r"list_filter(list_transform(regexp_split_to_array({}, '\s+'), lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', '', 'g')), lambda x: x <> '')"

#: Overlaps by spaced seeds, for items of at least as many words as the masks need, written with spaces.
OVERLAPS = f"""
WITH b AS (SELECT row_number() OVER () k, item_id, ws, len(ws) n, least({decontam.NEED_WORDS}, ceil({decontam.NEED_SHARE} * len(ws))) need FROM (SELECT DISTINCT item_id, {_WORDS.format('text')} ws FROM benchmark)),
d AS (SELECT doc_id, {_WORDS.format('text')} ws FROM documents),
bs AS (SELECT k, s.* FROM b, LATERAL ({_seeds('b.ws', 'b.n')}) s),
ds AS (SELECT doc_id, s.* FROM d, LATERAL ({_seeds('d.ws', 'len(d.ws)')}) s),
g AS (SELECT DISTINCT doc_id, k, ds.pos - bs.pos diag FROM ds JOIN bs USING (mask, seed)),
c AS (SELECT doc_id, k, diag, j, CASE WHEN j >= 0 AND diag + j >= 0 THEN coalesce(d.ws[diag + j + 1] = b.ws[j + 1], false) ELSE false END same FROM g JOIN b USING (k) JOIN d USING (doc_id), LATERAL (SELECT unnest(range(-1, b.n)) j) q),
s AS (SELECT *, j + 1 e, sum(CASE WHEN j < 0 THEN 0 WHEN same THEN 1 ELSE -2 END) OVER (PARTITION BY doc_id, k, diag ORDER BY j) c FROM c),
l AS (SELECT *, min(c) OVER (PARTITION BY doc_id, k, diag ORDER BY e) low FROM s),
m AS (SELECT doc_id, k, diag, arg_max({{'e': e, 'low': low}}, (c - low, -e)) x FROM l GROUP BY ALL HAVING max(c - low) > 0),
f AS (SELECT doc_id, k, diag, x.e stop, max(l.e) start FROM m JOIN l USING (doc_id, k, diag) WHERE l.e <= x.e AND l.c = x.low GROUP BY ALL),
a AS (SELECT doc_id, k, diag, start + diag f0, stop + diag f1, j FROM f JOIN c USING (doc_id, k, diag) WHERE same AND j >= start AND j < stop),
h AS (SELECT g.doc_id, g.k, g.diag, count(DISTINCT j) n_agree, min(f0) f0, max(f1) f1 FROM g JOIN a ON a.doc_id = g.doc_id AND a.k = g.k AND a.diag BETWEEN g.diag AND g.diag + {decontam.DRIFT} GROUP BY ALL)
SELECT doc_id, item_id, n_agree::INT n_agree, n::INT item_words, f0::INT first_word, f1::INT end_word FROM h JOIN b USING (k) WHERE n_agree >= need
QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY n_agree DESC, diag) = 1
"""

#: The primes of XXH64 (fixed values).
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_M = "18446744073709551615::UHUGEINT"


def _big(n: int) -> str:
    return f"{n % (1 << 64)}::UHUGEINT"


def _mul(a: str, p: int) -> str:
    return f"((({a}) * {_big(_P[p - 1])}) & {_M})"


def _turn(a: str, n: int) -> str:
    return f"(((({a}) * {_big(1 << n)}) & {_M}) + (({a}) // {_big(1 << (64 - n))}))"


def _fold(items: str, step: str, start: str) -> str:
    """Fold a list of numbers over a hash h with x for the item."""
    return f"list_reduce({items}, lambda h, x: {step}, {start})"


def _round(acc: str, lane: str) -> str:
    return _mul(_turn(f"(({acc} + {_mul(lane, 2)}) & {_M})", 31), 1)


def _xxh64(seed: int) -> str:
    """CTEs from sh(s), distinct texts, to xx(s, h), their XXH64 as an unsigned number."""
    lane = lambda t, k, n: " || ".join(f"substr({t}, {k} + {2 * (n - 1 - i) + 1}, 2)" for i in range(n))
    whole = f"list_transform(range(0, len(x) // 64), lambda k: [{', '.join(f'''('0x' || {lane('x', f'64 * k + {16 * j}', 8)})::UBIGINT::UHUGEINT''' for j in range(4))}])"
    eights = f"list_transform(range(len(x) // 64 * 4, len(x) // 16), lambda k: ('0x' || {lane('x', '16 * k', 8)})::UBIGINT::UHUGEINT)"
    four = f"CASE WHEN len(x) % 16 >= 8 THEN [('0x' || {lane('x', '(len(x) // 16 * 16)', 4)})::UBIGINT::UHUGEINT] ELSE [] END"
    ones = "list_transform(range(len(x) // 8 * 8, len(x), 2), lambda k: ('0x' || substr(x, k + 1, 2))::UBIGINT::UHUGEINT)"
    stripe = lambda i: f"list_reduce(list_transform(w, lambda y: y[{i + 1}]), lambda h, y: {_round('h', 'y')}, {_big((seed + _P[0] + _P[1], seed + _P[1], seed, seed - _P[0])[i])})"
    merge = lambda h, v: f"(({_mul(f'xor({h}, {_round(_big(0), v)})', 1)} + {_big(_P[3])}) & {_M})"
    joined = f"(({_turn('v1', 1)} + {_turn('v2', 7)} + {_turn('v3', 12)} + {_turn('v4', 18)}) & {_M})"
    eight = _fold("e", f"({_mul(_turn(f'xor(h, {_round(_big(0), chr(120))})', 27), 1)} + {_big(_P[3])}) & {_M}", "h0")
    fours = _fold("f", f"({_mul(_turn(f'xor(h, {_mul(chr(120), 1)})', 23), 2)} + {_big(_P[2])}) & {_M}", "h1")
    bytes_ = _fold("o", _mul(_turn(f"xor(h, {_mul('x', 5)})", 11), 1), "h2")
    down = lambda h, n: f"xor({h}, {h} // {_big(1 << n)})"
    return f"""
x0 AS (SELECT s, hex(encode(s)) x FROM sh),
x1 AS (SELECT s, len(x) // 2 n, {whole} w, {eights} e, {four} f, {ones} o FROM x0),
x2 AS (SELECT *, {', '.join(f'{stripe(i)} v{i + 1}' for i in range(4))} FROM x1),
x3 AS (SELECT *, {joined} j0 FROM x2), x4 AS (SELECT *, {merge('j0', 'v1')} j1 FROM x3), x5 AS (SELECT *, {merge('j1', 'v2')} j2 FROM x4), x6 AS (SELECT *, {merge('j2', 'v3')} j3 FROM x5),
x7 AS (SELECT *, ((CASE WHEN n < 32 THEN {_big(seed + _P[4])} ELSE {merge('j3', 'v4')} END) + n::UHUGEINT) & {_M} h0 FROM x6),
x8 AS (SELECT *, {eight} h1 FROM x7), x9 AS (SELECT *, {fours} h2 FROM x8), x10 AS (SELECT *, {bytes_} h3 FROM x9),
x11 AS (SELECT s, {_mul(down('h3', 33), 2)} h FROM x10), x12 AS (SELECT s, {_mul(down('h', 29), 3)} h FROM x11), xx AS (SELECT s, {down('h', 32)} h FROM x12)"""


#: Fingerprints over 3-word shingles, all pairs within the distance, and their components.
SIMHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
t AS (SELECT doc_id, array_to_string(ws[i + 1:i + {simhash.SHINGLE}], ' ') s FROM d, LATERAL (SELECT unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - {simhash.SHINGLE - 1}) END)) i) q),
sh AS (SELECT DISTINCT s FROM t), {_xxh64(simhash.SEED)},
v AS (SELECT doc_id, count(*) n, [{', '.join(f'sum((h // {_big(1 << b)} & 1)::INT)' for b in range(64))}] c FROM t JOIN xx USING (s) GROUP BY 1),
p AS (SELECT doc_id, coalesce(list_sum(list_transform(c, lambda x, i: CASE WHEN 2 * x > n THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END)), 0)::UBIGINT fp FROM d LEFT JOIN v USING (doc_id)),
u AS (SELECT fp, min(doc_id) node FROM p GROUP BY 1),
l AS (SELECT a.node x, b.node y FROM u a JOIN u b ON a.node <> b.node AND bit_count(xor(a.fp, b.fp)) <= {simhash.DISTANCE}),
r AS (SELECT node, node root FROM u UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') fingerprint, component_id FROM p JOIN u USING (fp) JOIN (SELECT node, min(root) component_id FROM r GROUP BY 1) USING (node)
"""
