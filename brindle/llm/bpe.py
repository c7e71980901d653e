"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one vocabulary token can be the last token
of that prefix's BPE encoding. Candidates are the tokens that are suffixes of
the prefix (an Aho-Corasick automaton over the vocabulary lists them); the
right one is the one that is compatible with the last token stored for the
prefix before it. Two tokens are compatible if BPE, run on their joined
strings, would never merge across their boundary. Following the back-pointers
from the whole word gives the ids, in time linear in the word's length.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, texts

#: Entries of a worker's caches of chunks, words and token pairs; at its bound a cache starts anew.
CACHE = 600_000
WORD_CACHE = 50_000
PAIRS = 600_000

#: White space of Unicode (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Control characters that str.split takes as white space and the vocabulary does not.
ODD = regex.compile("[\x1c-\x1f]")
END = 0x1000  # symbols from here on are bytes that end a word


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBPE:
    """Encoder and decoder for a tokenizer file of byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocab = model["vocab"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.inner = [chr(b + 1) for b in range(256)]
        self.final = [chr(END + b) for b in range(256)]

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            body = [byte_of[c] for c in (token[: -len(suffix)] if ends else token)]
            s = [self.inner[b] for b in body]
            if ends:
                s[-1] = self.final[body[-1]]
            return "".join(s)

        n = max(vocab.values()) + 1
        self.shown = [""] * n
        self.length = [0] * n
        for t, i in vocab.items():
            self.shown[i] = t
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.rank = [-1] * n
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            ia, ib, ic = vocab[a], vocab[b], vocab[a + b]
            self.merged[ia, ib] = ic
            if self.parts[ic] is None:
                self.parts[ic], self.rank[ic] = (ia, ib), r
        self.shown += [""] * (max(self.special.values(), default=-1) + 1 - n)
        for t, i in self.special.items():
            self.shown[i] = t
        self.automaton = ahocorasick.Automaton()
        known = [i for i in vocab.values() if len(symbols(self.shown[i])) == 1 or self.parts[i] is not None]
        for i in known:
            s = symbols(self.shown[i])
            self.length[i] = len(s)
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.decimal = [str(i) for i in range(len(self.shown))]
        self.dtype = np.dtype("<u2" if len(self.shown) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        # a token that BPE never gives for its own string can end no prefix
        dead = [i for i in known if self.parts[i] and self._last(symbols(self.shown[i])) != i]
        if dead:
            for i in dead:
                self.automaton.remove_word(symbols(self.shown[i]))
            self.automaton.make_automaton()
            self.pairs.clear()

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE on the strings of a and b, joined, keeps the boundary between them."""
        rank, parts, merged = self.rank, self.parts, self.merged
        limit = len(rank) + 1  # merges across the boundary count only if they come before this rank
        while True:
            c = merged.get((a, b))
            if c is not None and rank[c] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            # undo the later merge; on a tie of ranks the left one came first
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]

    def _last(self, s: str) -> int:
        return self._encode_symbols(s)[-1]

    def _encode_symbols(self, s: str) -> list[int]:
        last = [-1] * (len(s) + 1)
        pairs, length = self.pairs, self.length
        for at, i in self.automaton.iter(s):  # by end of match
            if last[at + 1] >= 0:
                continue
            start = at + 1 - length[i]
            if start:
                key = last[start] << 20 | i
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self._compatible(last[start], i)
                if ok:
                    last[at + 1] = i
            else:  # a token that is the whole prefix is its own encoding
                last[at + 1] = i
        out, at = [], len(s)
        while at:
            i = last[at]
            out.append(i)
            at -= length[i]
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            b = word.encode("utf-8")
            inner = self.inner
            ids = array(self.code, self._encode_symbols("".join([inner[x] for x in b[:-1]]) + self.final[b[-1]])).tobytes()
            if len(word) <= 64:
                if len(self.words) >= WORD_CACHE:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def normalise(self, text: str) -> str:
        """NFC, then each character's own lower-case form (no rule for a word's last sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def _piece(self, text: str) -> bytes:
        """Ids of a stretch of text that holds no special token."""
        return b"".join([self._word(w) for w in WORDS.findall(self.normalise(text))])

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as packed little-endian integers of self.dtype.

        White space ends every word, so chunks between it are encoded alone, and only once while the cache holds them.
        """
        if ODD.search(text) is not None or (self.special_re and "<|" in text):
            out, at = [], 0
            for m in self.special_re.finditer(text) if self.special_re else ():
                out += [self._piece(text[at : m.start()]), self.dtype.type(self.special[m[0]]).tobytes()]
                at = m.end()
            return b"".join([*out, self._piece(text[at:])])
        cache = self.chunks
        chunks = text.split()
        out = list(map(cache.get, chunks))
        if None in out:
            if len(cache) >= CACHE:
                cache.clear()
            for k, x in enumerate(out):
                if x is None:
                    c = chunks[k]
                    x = cache.get(c)
                    if x is None:
                        x = self._piece(c)
                        if len(c) <= 64:
                            cache[c] = x
                    out[k] = x
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), self.dtype).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings, joined by spaces: the file names no decoder."""
        shown = self.shown
        return " ".join([shown[i] for i in ids])


@lru_cache(maxsize=4)
def encoder(path: str) -> WordBPE:
    """The encoder of a vocabulary file, one per worker process."""
    return WordBPE(path)


def encode_documents(docs: DataFrame, vocab: str, ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    docs needs doc_id and text; other columns are ignored, so their names may
    clash with the result's. A null text counts as empty: no tokens, digests of
    the empty string. A text of any length is encoded whole, in time linear in
    it. Repeated rows give repeated results, a null doc_id stays
    null, an empty table gives an empty result. With ids=True the token ids and
    the decoded text come along.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(vocab)
        decimal = e.decimal
        n, enc, dec, all_ids, all_text = [], [], [], [], []
        for t in texts(b):
            got = e.encode(t)
            decoded = e.decode(got)
            n.append(len(got))
            enc.append(hashlib.sha256(" ".join([decimal[i] for i in got]).encode()).hexdigest())
            dec.append(hashlib.sha256(decoded.encode()).hexdigest())
            if ids:
                all_ids.append(np.array(got, np.int32))
                all_text.append(decoded)
        cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            ends = np.cumsum([0, *n]).astype(np.int32)
            cols += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids))), pa.array(all_text, pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else ""))
