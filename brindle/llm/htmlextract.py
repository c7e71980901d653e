"""HTML main text by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between block-level tags. A
block's vector holds its hashed tag path (tags, classes and ids of all its
ancestors), hashed words and a few measures. A bidirectional LSTM in numpy reads
the blocks of a whole page in order and labels each as main text or not. It is
trained here, on pages that a generator composes with known labels, from a fixed
seed.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts

PATH_DIM, WORD_DIM, HIDDEN = 256, 32, 24
MEASURES = 7
DIM = PATH_DIM + WORD_DIM + MEASURES
#: Block steps of one padded batch, which bounds memory.
BATCH_STEPS = 40_000
#: Blocks whose vectors are held at once.
STRETCH = 8192

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style title noscript template textarea iframe svg math object canvas audio video select datalist xmp noembed noframes".split())
#: An opening tag closes these if they are open, up to the given ancestors.
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: A comment or the like, or the beginning of a tag.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_MARK = re.compile("[>\"']")
_TAIL = re.compile("<[!?]")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)


class Path:
    """A block-level element inside its ancestors: their number of marks, its own marks, and those of them that no ancestor has."""

    __slots__ = ("above", "depth", "marks", "new", "size")

    def __init__(self, above: Path | None, marks: tuple[str, ...], new: tuple[str, ...]):
        self.above, self.marks, self.new = above, marks, new
        self.depth = above.depth + 1 if above else 0
        self.size = (above.size if above else 0) + len(marks)

    def below(self, marks: tuple[str, ...]) -> Path:
        """A path below this one, from a walk over all ancestors: for short paths."""
        had, at = set(), self
        while at:
            had.update(at.marks)
            at = at.above
        return Path(self, marks, tuple(t for t in dict.fromkeys(marks) if t not in had))


ROOT = Path(None, (), ())


def path_of(marks: tuple[str, ...]) -> Path:
    return ROOT.below(marks) if marks else ROOT


@dataclass
class Leaf:
    """A block: the element it is in, its text, and how much of that is inside links."""

    path: Path
    text: str
    linked: float


class _Open:
    """The stack of open elements. Every question is answered in constant time, however deep it is."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[Path] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.had: dict[str, int] = {}

    def here(self) -> Path:
        return self.paths[-1] if self.paths else ROOT

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name, -1 without one."""
        places = self.at.get(name)
        return places[-1] if places else -1

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def push(self, name: str, marks: tuple[str, ...]) -> None:
        path = self.here()
        if name not in INLINE:
            path = Path(path, marks, tuple(t for t in dict.fromkeys(marks) if not self.had.get(t)))
            for t in marks:
                self.had[t] = self.had.get(t, 0) + 1
            self.blocks.append(len(self.names))
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.paths.append(path)

    def pop(self, to: int) -> None:
        """Close everything from a place on."""
        while len(self.names) > to:
            name, path = self.names.pop(), self.paths.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()
                for t in path.marks:
                    self.had[t] -= 1


class _Ends:
    """Where tags end: at the first > outside quotes, or the first of all if a quote stays open. What lies behind a quote is looked up once."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[int, int] = {}

    def after(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin at a place; -1 without one."""
        page, way, end = self.page, [], -1
        m = _MARK.search(page, at)
        while m:
            q = m.start()
            if m[0] == ">":
                end = q
                break
            if q in self.known:
                end = self.known[q]
                break
            way.append(q)
            closing = page.find(m[0], q + 1)
            m = _MARK.search(page, closing + 1) if closing >= 0 else None
        for q in way:
            self.known[q] = end
        return end if end >= 0 else page.find(">", at)


def leaves(page: str) -> list[Leaf]:
    """The text blocks of a page, in order, in time linear in its length. Broken, unclosed and nested markup gives blocks too; nothing raises."""
    out: list[Leaf] = []
    stack = _Open()
    parts: list[str] = []
    linked = 0
    ends = _Ends(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(stack.here(), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if stack.at.get("a"):
                linked += len(text)

    at, low = 0, None
    while True:
        m = _TAG.search(page, at)
        end = m.end() if m and not m[2] else ends.after(m.end()) + 1 if m else 0
        if not end:  # no tag begins after the last >
            add(page[at:] if m is None else page[at : m.start()])
            if m is None:
                break
            tail = _TAIL.search(page, m.start())
            add(page[m.start() : tail.start()] if tail else page[m.start() :])
            break
        add(page[at : m.start()])
        at = end
        if not m[2]:
            continue
        name, closing, attrs = m[2].lower(), m[1], page[m.end() : end - 1]
        if closing:
            if name not in INLINE:
                flush()
            k = stack.last(name)
            if k >= 0 and (name not in INLINE or k > stack.last_block()):
                stack.pop(k)
            continue
        if name in DROPPED:
            if name not in ("svg", "math", "canvas", "object"):
                flush()
            if not attrs.endswith("/"):
                if low is None:
                    low = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
                end = low.find(f"</{name}", at)
                at = len(page) if end < 0 else end
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in _P_ENDERS or name == "p":
                k = stack.last_block()
                if k >= 0 and stack.names[k] == "p":
                    stack.pop(k)
            if name in CLOSES:
                inner, within = CLOSES[name]
                while (k := max(map(stack.last, inner))) > max(map(stack.last, within)):
                    stack.pop(k)
                    if name != "tr":
                        break
        if name in VOID:
            continue
        marks = [name]
        for a in _ATTR.finditer(attrs):
            marks += ["." + w for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
        if _HIDDEN.search(attrs):
            marks.append(".hidden")
        stack.push(name, tuple(marks))
    flush()
    return out


@lru_cache(maxsize=50_000)
def _slot(token: str) -> tuple[int, int]:
    """Place and sign of a hashed token in a path's vector."""
    h = zlib.crc32(token.encode())
    return h % PATH_DIM, 1 if h >> 31 else -1


class _PathVector:
    """The vector of a path, moved from one to the next over their common ancestor, so that a page costs its tree's edges."""

    def __init__(self):
        self.v, self.path = np.zeros(PATH_DIM, np.float32), ROOT

    def _step(self, path: Path, sign: int) -> None:
        for t in path.new:
            if t != "html" and t != "body":
                at, s = _slot(t)
                self.v[at] += sign * s

    def put(self, path: Path, out: np.ndarray) -> None:
        """Write the vector of a path, with the mark of its last element, to out."""
        down, a, b = [], self.path, path
        while a is not b:
            if a.depth >= b.depth:
                self._step(a, -1)
                a = a.above
            else:
                down.append(b)
                b = b.above
        for x in reversed(down):
            self._step(x, 1)
        self.path = path
        out[:] = self.v
        if path.marks:
            at, s = _slot("leaf " + path.marks[-1])
            out[at] += s


_PLACE = np.random.default_rng(23).integers(1, 1 << 32, 64, np.uint32) | np.uint32(1)


def _word_vectors(blocks: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the hashed words of each block, and the number of words; all words of a page are hashed at once."""
    data = np.frombuffer("\n".join([b.text.lower() for b in blocks]).encode("utf-8", "replace"), np.uint8)
    line = data == 10
    gap = line | (data == 32)
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    h = np.add.reduceat(np.where(gap, np.uint32(0), (data.astype(np.uint32) + np.uint32(1)) * _PLACE[place & 63]), starts, dtype=np.uint32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    block = np.cumsum(line)[starts]
    slot = block * WORD_DIM + ((h >> np.uint32(8)) % np.uint32(WORD_DIM)).astype(np.int64)
    v = np.bincount(slot, weights=np.where(h >> np.uint32(31), 1.0, -1.0), minlength=len(blocks) * WORD_DIM).reshape(len(blocks), WORD_DIM)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1), np.bincount(block, minlength=len(blocks))


def vectors(blocks: list[Leaf], at: int = 0, total: int | None = None, walk: _PathVector | None = None) -> np.ndarray:
    """Vectors of a page's blocks, or of a stretch of them that begins at a place of `total` blocks."""
    x = np.zeros((len(blocks), DIM), np.float32)
    if not blocks:
        return x
    walk, total = walk or _PathVector(), total or len(blocks)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM], counts = _word_vectors(blocks)
    for k, b in enumerate(blocks):
        walk.put(b.path, x[k, :PATH_DIM])
        t = b.text
        x[k, PATH_DIM + WORD_DIM :] = (0, b.linked, (t.count(".") + t.count(",") + t.count(";")) / len(t) * 10, t[-1] in ".!?", min(b.path.size, 30) / 10, (at + k + 1) / total, 1.0)
    x[:, PATH_DIM + WORD_DIM] = np.log1p(counts) / 4
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["w" + d] = (rng.normal(size=(DIM, 4 * h)) * 0.08).astype(np.float32)
            self.p["u" + d] = (rng.normal(size=(h, 4 * h)) * 0.15).astype(np.float32)
            b = np.zeros(4 * h, np.float32)
            b[h : 2 * h] = 1  # remember at first
            self.p["c" + d] = b
        self.p["out"] = (rng.normal(size=(2 * h, 1)) * 0.2).astype(np.float32)
        self.p["skip"] = np.zeros((DIM, 1), np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states over (time, page, vector); padding leaves the state as it is."""
        t, n, h = len(x), x.shape[1], HIDDEN
        z = (x.reshape(-1, DIM) @ self.p["w" + d] + self.p["c" + d]).reshape(t, n, 4 * h)
        state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((t, n, h), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[k] + state @ self.p["u" + d]
            s = _sigmoid(a[:, : 3 * h])
            g = np.tanh(a[:, 3 * h :])
            m = mask[k][:, None]
            new = s[:, h : 2 * h] * cell + s[:, :h] * g
            tc = np.tanh(new)
            kept.append((k, state, cell, s, g, tc, m))
            cell = m * new + (1 - m) * cell
            state = m * (s[:, 2 * h :] * tc) + (1 - m) * state
            out[k] = state
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, kf = self._run(x, mask, "f")
        b, kb = self._run(x, mask, "b")
        both = np.concatenate([f, b], 2)
        y = (both @ self.p["out"])[..., 0] + (x @ self.p["skip"])[..., 0] + self.p["bias"]
        return y, (both, kf, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        y, (both, kf, kb) = self.logits(x, mask)
        dy = ((_sigmoid(y) - target) * mask / mask.sum())[..., None].astype(np.float32)
        g = {"out": np.einsum("tnh,tno->ho", both, dy), "skip": np.einsum("tnd,tno->do", x, dy), "bias": dy.sum((0, 1))}
        dboth = dy @ self.p["out"].T
        h = HIDDEN
        for d, kept, dh_all in (("f", kf, dboth[..., :h]), ("b", kb, dboth[..., h:])):
            u = self.p["u" + d]
            dz = np.zeros((*x.shape[:2], 4 * h), np.float32)
            du = np.zeros_like(u)
            dstate, dcell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for k, state, cell, s, gate, tc, m in reversed(kept):
                ds = dstate + dh_all[k]
                live = ds * m
                dc = dcell * m + live * s[:, 2 * h :] * (1 - tc * tc)
                a = np.concatenate([dc * gate * s[:, :h] * (1 - s[:, :h]), dc * cell * s[:, h : 2 * h] * (1 - s[:, h : 2 * h]), live * tc * s[:, 2 * h :] * (1 - s[:, 2 * h :]), dc * s[:, :h] * (1 - gate * gate)], 1)
                dz[k] = a
                du += state.T @ a
                dstate = a @ u.T + ds * (1 - m)
                dcell = dc * s[:, h : 2 * h] + dcell * (1 - m)
            flat = dz.reshape(-1, 4 * h)
            g["w" + d], g["u" + d], g["c" + d] = x.reshape(-1, DIM).T @ flat, du, flat.sum(0)
        return g

    def inputs(self, blocks: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
        """What the gates of both directions and the output take from each block's vector; the vectors themselves are made and dropped in stretches."""
        w = np.concatenate([self.p["wf"], self.p["wb"], self.p["skip"]], 1)
        walk, out = _PathVector(), np.zeros((len(blocks), w.shape[1]), np.float32)
        for at in range(0, len(blocks), STRETCH):
            out[at : at + STRETCH] = vectors(blocks[at : at + STRETCH], at, len(blocks), walk) @ w
        return out[:, :-1] + np.concatenate([self.p["cf"], self.p["cb"]]), out[:, -1]

    def scores(self, z: np.ndarray, skip: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Output for each (time, page) from the inputs; both directions step together, the backward one from the end."""
        t, n, h = len(z), z.shape[1], HIDDEN
        z = z.reshape(t, n, 2, 4 * h)
        u = np.stack([self.p["uf"], self.p["ub"]])
        o = self.p["out"].reshape(2, h)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        y = skip + self.p["bias"]
        whole = mask.all(1)
        with np.errstate(over="ignore"):
            for k in range(t):
                j = t - 1 - k
                a = state @ u
                a[0] += z[k, :, 0]
                a[1] += z[j, :, 1]
                s = 1 / (1 + np.exp(-a[:, :, : 3 * h]))
                new = s[:, :, h : 2 * h] * cell + s[:, :, :h] * np.tanh(a[:, :, 3 * h :])
                to = s[:, :, 2 * h :] * np.tanh(new)
                if whole[k] and whole[j]:
                    cell, state = new, to
                else:
                    m = np.stack([mask[k], mask[j]])[:, :, None]
                    cell, state = m * new + (1 - m) * cell, m * to + (1 - m) * state
                y[k] += state[0] @ o[0]
                y[j] += state[1] @ o[1]
        return y

    def label(self, pages: list[list[Leaf]]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(pages[order[stop]]) * (stop + 1 - at) <= BATCH_STEPS and stop - at < 512:
                stop += 1
            group = order[at:stop]
            t = len(pages[group[-1]])
            z, skip, mask = np.zeros((t, len(group), 8 * HIDDEN), np.float32), np.zeros((t, len(group)), np.float32), np.zeros((t, len(group)), np.float32)
            for j, k in enumerate(group):
                n = len(pages[k])
                z[:n, j], skip[:n, j] = self.inputs(pages[k])
                mask[:n, j] = 1
            y = self.scores(z, skip, mask) > 0
            for j, k in enumerate(group):
                out[k] = y[: len(pages[k]), j]
            at = stop
        return out


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), DIM), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


class _Pages:
    """Composes labelled training pages: lists of (block, is main text)."""

    MENUS = ("nav", "div.nav", "div.menu", "ul.menu", "div.navbar", "div.navigation", "div.breadcrumb", "div.breadcrumbs", "nav.nav", "div.topnav", "div.tabs", "nav.pagination", "div.pager", "div.toc")
    HEADERS = ("header", "div.header", "div.masthead", "div.top", "div.site.header", "header.header", "div.logo", "div.branding", "div.banner", "hgroup")
    FOOTERS = ("footer", "div.contentinfo", "div.footer", "div.site.footer", "footer.footer", "div.bottom", "div.copyright", "div.legal", "div.colophon")
    SIDES = ("aside", "aside", "aside", "div.sidebar", "aside.sidebar", "div.widget", "div.related", "section.related", "div.recommended", "div.side", "div.popular", "div.trending", "div.author.bio", "div.tags", "div.share", "div.social", "ul.share", "div.more", "div.rail")
    NOTICES = ("div.cookie", "div.cookies", "div.notice", "div.consent", "div.gdpr", "div.alert", "div.banner.cookie", "section.notice", "div.popup", "div.modal", "dialog", "div.paywall", "div.toast", "div.disclaimer", "p.notice", "div.message", "div.privacy")
    ADS = ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "section.ad", "aside.ad", "div.banner.ad", "div.adsense", "p.ad", "div.sponsor", "div.promotion", "ins.adsbygoogle", "div.ad.slot", "div.ad.box")
    FORMS = ("form", "form.search", "div.search.form", "form.newsletter", "div.newsletter", "div.subscribe", "form.login", "form.contact", "form.comment.form", "fieldset", "div.signup")
    COMMENTS = ("section.comments", "div.comments", "ol.comment.list", "div.comment", "div.respond", "div.replies", "div.discussion", "ul.comments", "div.disqus", "section.comment", "aside.comments", "div.reader.comments", "div.responses", "div.feedback", "div.reviews")
    MAINS = ("article", "main", "main/article", "div.content", "div.post", "div.entry", "div.article", "article.post", "div.main", "div.story", "section", "div.main/article", "div.page/main", "div.post.content", "div.article.body", "section.content", "div.text", "div.wrapper/article", "div.container/main/article", "body", "div", "div.entry.content", "main/div.content", "main/section")

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[self.rng.integers(len(xs))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, n: int) -> str:
        syl = self.pick((["th", "er", "on", "an", "re", "in", "ed", "ha"], ["le", "ou", "é", "ai", "qu", "tion", "ment"], ["en", "ch", "sch", "ge", "ü", "be"], ["ci", "ón", "as", "ra", "do", "que"], ["ka", "mi", "lo", "ta", "su"]))
        out = ["".join(self.pick(syl) for _ in range(self.rng.integers(1, 5))) for _ in range(n)]
        junk = self.pick(["", "", "", "", "", "&&&", "***", "!!", "###", " |"])
        for k in range(n):
            if self.chance(0.12):
                out[k] += self.pick([",", "."])
            out[k] += junk
        out[0] = out[0].capitalize()
        return " ".join(out) + self.pick([".", ".", ".", ""])

    def path(self, spec: str) -> tuple[str, ...]:
        out: list[str] = []
        for part in spec.split("/"):
            tag, *marks = part.split(".")
            out += [tag, *["." + m for m in marks]]
        return tuple(out)

    def block(self, page, base, leaf, n, main, linked=0.0):
        page.append((Leaf(path_of(base + ((leaf,) if leaf else ())), self.words(max(1, n)), linked), main))

    def other(self, page, base: tuple[str, ...], kinds) -> None:
        kind = self.pick(kinds)
        at = base + self.path(self.pick(kind))
        if kind is self.MENUS or (kind is self.SIDES and self.chance(0.5)):
            for _ in range(self.rng.integers(2, 9)):
                self.block(page, at + (("ul",) if self.chance(0.8) else ()), "li", self.rng.integers(1, 4), False, 1.0)
        elif kind is self.FORMS:
            for _ in range(self.rng.integers(1, 4)):
                self.block(page, at, self.pick(["", "p", "button", "div", "legend"]), self.rng.integers(1, 7), False)
        elif kind is self.COMMENTS:
            for _ in range(self.rng.integers(1, 6)):
                inner = at + self.pick([(), ("div", ".comment"), ("li",), ("article", ".comment"), ("div",)])
                if self.chance(0.4):
                    self.block(page, inner, self.pick(["div", "h3", "p", "h4"]), self.rng.integers(1, 4), False)
                self.block(page, inner, self.pick(["p", "p", "div", "", "blockquote"]), self.rng.integers(3, 50), False)
        else:
            for _ in range(self.rng.integers(1, 4)):
                self.block(page, at, self.pick(["", "", "p", "div", "h3", "span"]), self.rng.integers(2, 30), False, float(self.chance(0.2)))

    def page(self) -> list[tuple[Leaf, bool]]:
        page: list[tuple[Leaf, bool]] = []
        wrap = self.pick([(), (), (), ("div",), ("div", ".wrapper"), ("div", ".page"), ("div", ".container"), ("div", ".layout")])
        before = [self.HEADERS, self.MENUS, self.NOTICES, self.ADS, self.SIDES, self.FORMS]
        after = [self.SIDES, self.ADS, self.COMMENTS, self.COMMENTS, self.FORMS, self.NOTICES, self.MENUS]
        for _ in range(self.rng.integers(0, 5)):
            self.other(page, wrap, before)
        at = wrap + self.path(self.pick(self.MAINS)) if self.chance(0.6) else wrap + self.pick([("article",), ("main",)])
        if at[-1] == "body":
            at = wrap
        if self.chance(0.85):
            head = self.pick([("header",), ("div", ".header"), ("div", ".title")]) if self.chance(0.12) else ()
            self.block(page, at + head, self.pick(["h1", "h1", "h1", "h2"]), self.rng.integers(1, 14), True)
        inside = self.chance(0.55)
        for _ in range(self.rng.integers(1, 16)):
            part = at + (("section",) if self.chance(0.1) else ("div",) if self.chance(0.08) else ())
            kind = self.rng.random()
            if kind < 0.03:  # pages do repeat themselves
                text = self.words(self.rng.integers(1, 5)) if self.chance(0.5) else " ".join([self.words(1)] * self.rng.integers(3, 60))
                for _ in range(self.rng.integers(1, 12)):
                    page.append((Leaf(path_of(part + ("p",)), text, 0.0), True))
            elif kind < 0.72:
                self.block(page, part, "p", self.rng.integers(1, 70), True, 0.0 if self.chance(0.9) else float(self.rng.random() * 0.5))
            elif kind < 0.80:
                self.block(page, part, self.pick(["h2", "h3", "h4"]), self.rng.integers(1, 9), True)
            elif kind < 0.86:
                for _ in range(self.rng.integers(2, 6)):
                    self.block(page, part + (self.pick(["ul", "ol"]),), "li", self.rng.integers(1, 16), True)
            elif kind < 0.92:
                self.block(page, part + self.pick([("blockquote",), ("blockquote",), ("figure",), ("pre",), ("dl",), ("table", "tr")]), self.pick(["p", "td", "figcaption", "", "dd"]), self.rng.integers(1, 30), True)
            else:
                self.block(page, part, "", self.rng.integers(2, 40), True)
            if inside and self.chance(0.2):
                self.other(page, part, [self.ADS, self.NOTICES, self.SIDES, self.FORMS, ("aside", "aside", "nav", "form")])
        if self.chance(0.15):
            self.other(page, at, [self.COMMENTS])
        if self.chance(0.06):
            self.other(page, at, [self.FOOTERS])
        for _ in range(self.rng.integers(0, 4)):
            self.other(page, wrap, after)
        if self.chance(0.75):
            self.other(page, wrap, [self.FOOTERS])
        return page


def train(seed: int = 5, pages: int = 2500, epochs: int = 14, batch: int = 64) -> Labeller:
    """Fit a labeller on generated pages; the same seed gives the same model."""
    source = _Pages(seed)
    made = [source.page() for _ in range(pages)]
    xs = [vectors([b for b, _ in p]) for p in made]
    ys = [np.array([m for _, m in p], np.float32) for p in made]
    order = sorted(range(pages), key=lambda k: len(xs[k]))
    groups = []
    for at in range(0, pages, batch):
        x, mask = _pad([xs[k] for k in order[at : at + batch]])
        y = np.zeros(mask.shape, np.float32)
        for j, k in enumerate(order[at : at + batch]):
            y[: len(ys[k]), j] = ys[k]
        groups.append((x, mask, y))
    model, rng, step = Labeller(seed), np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(p) for k, p in model.p.items()} for _ in range(2))
    for epoch in range(epochs):
        rate = 0.03 * 0.8**epoch
        for g in rng.permutation(len(groups)):
            step += 1
            grads = model.gradients(*groups[g])
            norm = np.sqrt(sum(float((q * q).sum()) for q in grads.values()))
            for k, q in grads.items():
                q = q * min(1.0, 1.0 / (norm + 1e-6))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7) - 1e-6 * model.p[k]).astype(np.float32)
    return model


@lru_cache(maxsize=1)
def default_model() -> Labeller:
    return train()


def main_text(page: str, model: Labeller) -> str:
    """Main text of one page."""
    blocks = leaves(page)
    return "\n\n".join(b.text for b, y in zip(blocks, model.label([blocks])[0], strict=True) if y) if blocks else ""


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    The whole html is read; a null or empty one gives an empty text. Character
    references are decoded, white space inside a block becomes one space, and
    the blocks that are main text are joined by two line feeds. Repeated rows
    come back repeated, an empty table gives an empty result, and other columns
    are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())  # a fixed number of weights

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        docs = texts(b, "html")
        for at in range(0, len(docs), 1000):
            blocks = [leaves(t) for t in docs[at : at + 1000]]
            marks = sent.value.label(blocks)
            out += ["\n\n".join([x.text for x, y in zip(xs, ys, strict=True) if y]) for xs, ys in zip(blocks, marks, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
