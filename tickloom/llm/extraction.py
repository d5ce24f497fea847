"""Main text of HTML pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags. Each block becomes a vector of hashed tag-path
parts (tags, classes, ids, roles), hashed words of its whole text and measures of the block and of the elements that hold it;
a bidirectional LSTM (numpy) reads the whole sequence and labels every block as main text or not. It is trained on a bounded
sample of the given pages, whose structural marks (article, main, nav, ...) label their blocks, and on the same texts set into
other page layouts: with telling names of many kinds, and with names that say nothing, where rails, teasers and a discussion
stand beside and under the text and only the document as a whole tells them apart.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pages and passes of training (more passes over few pages, to have as many steps), longest training sequence, vector and state sizes.
STEPS = 240
TRAIN_PAGES, EPOCHS, TRAIN_BLOCKS, PATH_DIMS, WORD_DIMS, STATE = 300, 6, 48, 48, 16, 20
MEASURES = 14
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
#: Blocks of pages that are labelled together.
BATCH_BLOCKS = 4096

#: A quote opens a value only behind "="; each part is possessive, so that no tag is read twice.
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|</?([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+)>|<[!?][^>]*+>""", re.S)
#: Elements without text of the page, each dropped up to its end.
HIDDEN = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template", "svg", "title")}
#: Tags that may stand in a head; any other one ends it, as </head> may be left out.
HEAD = frozenset("base basefont bgsound link meta title script style template noscript noframes svg".split())
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of paths that mark text outside the main text, and those that mark the main text.
OUTSIDE = frozenset("nav navigation navbar menu header footer aside sidebar ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal form newsletter subscribe signup login search share social related recommended breadcrumb breadcrumbs pagination comment comments reply replies disqus widget copyright legal button select option label".split())
INSIDE = frozenset("article main".split())
#: Fixed words for the layouts of training pages.
LAYOUT_BODY = ["article", "main", "div.content", "div.post", "div.entry-content", "section.story", "div#main", "div.article-body", "div.text"]
LAYOUT_OUT = ["nav", "header", "footer", "aside", "div.nav", "div.menu", "ul.menu", "div.sidebar", "div.header", "div.footer", "div.ad", "div.advert", "div.promo", "div.cookie-notice", "div.banner", "form", "form.newsletter", "div.related", "section.comments", "div.comment", "ol.comment-list", "div#comments", "div.share", "div.notice", "div.login", "div.breadcrumb", "div.subscribe", "div.alert"]


def hidden_end(page: str, tag: str, at: int, unclosed: set) -> int:
    """Where the element whose opening tag ends at ``at`` ends. Without a closing tag, script and style run to the
    page's end, as in browsers; of the others only the tag itself goes."""
    m = None if tag in unclosed else HIDDEN[tag].search(page, at)
    if m:
        return m.end()
    unclosed.add(tag)
    return len(page) if tag in ("script", "style") else at


def head_end(page: str, at: int, unclosed: set) -> int:
    """Where a head that is open at ``at`` ends: after </head>, or before the first tag that no head may hold."""
    for m in iter(lambda: TOKEN.search(page, at), None):
        tag, closing = (m[1] or "").lower(), page.startswith("</", m.start())
        if tag == "head" and closing:
            return m.end()
        if tag and not page.startswith("<!", m.start()) and tag not in HEAD and not (closing and tag not in ("body", "html")):
            return m.start()
        at = m.end()
        if tag in HIDDEN and not closing and not m[0].endswith("/>"):
            at = hidden_end(page, tag, at, unclosed)
    return len(page)


class Block:
    """A run of text: its path (names of the elements that hold it), text, share of link characters, and the numbers of the
    element around it (of the paragraph, item or heading, if it is one) and of the one around that."""

    __slots__ = ("path", "text", "link", "near", "far")

    def __init__(self, path, text, link, near=0, far=0):
        self.path, self.text, self.link, self.near, self.far = path, text, link, near, far


#: Elements that hold one block of a text; their parents hold the text.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th blockquote pre figcaption caption tr".split())


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order. Linear in the page's length."""
    out, path, parts, linked, at, in_link, unclosed, made = [], [], [], 0, 0, 0, set(), 0
    end = page.rfind(">") + 1  # no tag ends behind it

    def close():
        nonlocal linked
        text = SPACES.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            k = len(path) - 1
            while k > 0 and path[k][0] in LEAVES:
                k -= 1
            out.append(Block(tuple(x for _, names, _ in path for x in names), text, min(1.0, linked / len(text)), path[k][2] if path else 0, path[k - 1][2] if k > 0 else 0))
        parts.clear()
        linked = 0

    for m in iter(lambda: TOKEN.search(page, at, end) if at < end else None, None):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = (m[1] or "").lower()
        if not tag:
            continue
        closing = page.startswith("</", m.start())
        if tag == "head" or (tag in HIDDEN and tag != "title"):
            close()
            if not closing:
                if tag == "head":
                    at = head_end(page, at, unclosed)
                elif tag in ("script", "style") or not m[0].endswith("/>"):
                    at = hidden_end(page, tag, at, unclosed)
            continue
        if tag in INLINE:
            in_link = max(0, in_link + (-1 if closing else 1)) if tag == "a" else in_link
            if tag in ("br", "img"):
                parts.append(" ")
            continue
        close()
        in_link = 0
        if closing:
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] == tag:
                    del path[i:]
                    break
        elif tag not in VOID and not m[0].endswith("/>"):
            if path and path[-1][0] == tag and tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):
                path.pop()  # these end by the next one
            elif path and path[-1][0] == "p":
                path.pop()
            names = [tag]
            for a in ATTRIBUTE.finditer(m[2]):
                names += PART.findall(a[2].lower())
            made += 1
            path.append((tag, names, made))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


_HASHED: dict[str, tuple[int, float]] = {}


def _slot(word: str, dims: int) -> tuple[int, float]:
    k = _HASHED.get(word)
    if k is None:
        h = zlib.crc32(word.encode("utf-8", "replace"))
        k = (h >> 1, 1.0 if h & 1 else -1.0)
        if len(_HASHED) < 200_000:
            _HASHED[word] = k
    return k[0] % dims, k[1]


def vectors(page_blocks: list[Block]) -> np.ndarray:
    """One row for each block: hashed parts of the whole path (the n-th of a kind adds 1/n, so that deep pages look like
    others), hashed words of the whole text, and measures of the block, its neighbours and the elements that hold it."""
    n = len(page_blocks)
    x = np.zeros((n, DIMS), np.float32)
    row, slot, value = [], [], []
    size = np.array([len(b.text) for b in page_blocks], float)
    near, far = (np.unique([getattr(b, k) for b in page_blocks], return_inverse=True)[1] for k in ("near", "far"))
    for i, b in enumerate(page_blocks):
        times: dict[str, int] = {}
        for p in b.path:
            times[p] = times.get(p, 0) + 1
            k, sign = _slot(p, PATH_DIMS)
            x[i, k] += sign / times[p]
        words = b.text.lower().split(" ")
        weight = 1.0 / np.sqrt(len(words))
        for w in words:
            k, sign = _slot(w, WORD_DIMS)
            row.append(i)
            slot.append(PATH_DIMS + k)
            value.append(sign * weight)
        x[i, PATH_DIMS + WORD_DIMS :][:6] = (np.log1p(len(b.text)) / 5, np.log1p(len(words)) / 4, b.link, i / n, b.text[-1] in ".!?", "\u00a9" in b.text)
    np.add.at(x, (row, slot), np.array(value, np.float32))
    link = np.array([b.link for b in page_blocks])
    plain = size * (1 - link)
    head = np.array([any(p in ("h1", "h2") for p in b.path[-2:]) for b in page_blocks])
    more = x[:, PATH_DIMS + WORD_DIMS + 6 :]
    for k, group in enumerate((near, far)):
        total = np.bincount(group, plain)
        more[:, 2 * k] = total[group] / max(plain.sum(), 1.0)  # share of the page's text that the element holds
        more[:, 2 * k + 1] = total[group] / max(total.max(initial=0.0), 1.0)
    more[:, 4] = np.log1p(np.bincount(near)[near]) / 3
    more[1:, 5] = near[1:] == near[:-1]
    more[:-1, 6] = near[1:] == near[:-1]
    more[:, 7] = (np.bincount(near, head) > 0)[near]
    return x


def marked(path) -> bool:
    """Whether structural marks call a block main text; the last mark on the path decides, no mark means no."""
    inside = False
    for p in path:
        if p in OUTSIDE:
            return False
        if p in INSIDE:
            inside = True
    return inside


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.w = [(r.standard_normal((DIMS + STATE, 4 * STATE)) / np.sqrt(DIMS + STATE)).astype(np.float32) for _ in range(2)]
        self.b = [np.zeros(4 * STATE, np.float32) for _ in range(2)]
        for b in self.b:
            b[STATE : 2 * STATE] = 1  # remember at first
        self.o, self.c = (r.standard_normal(2 * STATE) * 0.2).astype(np.float32), np.zeros(1, np.float32)

    def _run(self, k: int, x: np.ndarray, live: np.ndarray, keep: bool):
        """x: time x pages x DIMS in reading order; padded steps leave the state as it is."""
        n = x.shape[1]
        h, c = np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32)
        first = x @ self.w[k][:DIMS] + self.b[k]
        out, memory = np.empty((len(x), n, STATE), np.float32), []
        for t in range(len(x)):
            z = first[t] + h @ self.w[k][DIMS:]
            s = 1 / (1 + np.exp(-z[:, : 3 * STATE]))
            i, f, o, g = s[:, :STATE], s[:, STATE : 2 * STATE], s[:, 2 * STATE :], np.tanh(z[:, 3 * STATE :])
            m = live[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                memory.append((h, c, i, f, o, g, th, m))
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[t] = h
        return out, memory

    def _back(self, k: int, x, memory, d_out):
        dw, db = np.zeros_like(self.w[k]), np.zeros_like(self.b[k])
        dh = dc = np.zeros(d_out.shape[1:], np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, th, m = memory[t]
            dh = dh + d_out[t]
            go, gc = np.where(m, dh, 0), np.where(m, dc, 0)
            gc = gc + go * o * (1 - th * th)
            dz = np.concatenate([gc * g * i * (1 - i), gc * c * f * (1 - f), go * th * o * (1 - o), gc * i * (1 - g * g)], axis=1)
            dw += np.concatenate([x[t], h], axis=1).T @ dz
            db += dz.sum(0)
            dh = np.where(m, 0, dh) + dz @ self.w[k][DIMS:].T
            dc = np.where(m, gc * f, dc)
        return dw, db

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """P(main text) of each block of each page, whole sequences, pages of like length together."""
        out: list = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group, longest = [], 0
            while at < len(order) and (not group or max(longest, len(pages[order[at]])) * (len(group) + 1) <= BATCH_BLOCKS):
                group.append(order[at])
                longest = max(longest, len(pages[order[at]]))
                at += 1
            x, live = pad([pages[i] for i in group])
            a, _ = self._run(0, x, live, False)
            b, _ = self._run(1, x[::-1], live[::-1], False)
            p = 1 / (1 + np.exp(-(np.concatenate([a, b[::-1]], axis=2) @ self.o + self.c[0])))
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i]), j]
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, size: int = 32):
        r, step = np.random.default_rng(2), 0
        params = [*self.w, *self.b, self.o, self.c]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for lo in range(0, len(order), size):
                some = order[lo : lo + size]
                x, live = pad([pages[i] for i in some])
                y = np.zeros(live.shape, np.float32)
                for j, i in enumerate(some):
                    y[: len(labels[i]), j] = labels[i]
                a, ma = self._run(0, x, live, True)
                b, mb = self._run(1, x[::-1], live[::-1], True)
                both = np.concatenate([a, b[::-1]], axis=2)
                p = 1 / (1 + np.exp(-(both @ self.o + self.c[0])))
                d = np.where(live, p - y, 0).astype(np.float32) / live.sum()
                g_o, g_c = np.einsum("tnh,tn->h", both, d), d.sum(keepdims=True).reshape(1)
                d_both = d[:, :, None] * self.o
                wa, ba = self._back(0, x, ma, d_both[:, :, :STATE])
                wb, bb = self._back(1, x[::-1], mb, d_both[::-1, :, STATE:])
                step += 1
                for k, g in enumerate((wa, wb, ba, bb, g_o, g_c)):
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """time x pages x DIMS and which steps are blocks. Padding stands at the end, where it changes no state."""
    n = max(map(len, pages))
    x, live = np.zeros((n, len(pages), DIMS), np.float32), np.zeros((n, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], live[: len(p), j] = p, True
    return x, live


def _page(rng, body: list[str], other: list[str]) -> tuple[str, list[float]]:
    """A page with the given main text among other blocks, and a label for each of its blocks. Half of the pages name their
    elements as sites do; the others by names that say nothing."""
    parts, label = [], []
    pick = lambda some: some[int(rng.integers(len(some)))]
    telling = rng.random() < 0.5
    empty_name = lambda: f"div.{''.join(chr(97 + int(i)) for i in rng.integers(0, 26, int(rng.integers(1, 4))))}"
    inside = lambda: pick(LAYOUT_BODY) if telling else pick(["div", "div", "section", empty_name(), empty_name()])
    outside = lambda: pick(LAYOUT_OUT) if telling else pick(["div", "div", "section", "ul", empty_name(), empty_name()])

    def opened(spec: str) -> str:
        tag, _, name = spec.replace("#", ".").partition(".")
        parts.append(f'<{tag} class="{name}">' if name else f"<{tag}>")
        return f"</{tag}>"

    def block(text: str, tag: str, main: bool, linked: bool = False):
        t = entities.escape(text)
        t = f'<a href="/x">{t}</a>' if linked else t
        parts.append(f"<{tag}>{t}</{tag}>" if tag else f"<div>{t}</div>")
        if text.strip():
            label.append(float(main))

    def words(k: int) -> str:
        return " ".join(pick(other).split(" ")[:k]) or "more"

    def menu():
        end = opened(outside())
        for _ in range(rng.integers(2, 9)):
            block(words(int(rng.integers(1, 5))), "li", False, True)
        parts.append(end)

    def rail():
        """Teasers: headings and first sentences of other texts."""
        end = opened(outside())
        if rng.random() < 0.5:
            block(words(2), pick(["h3", "h4", "p"]), False)
        for _ in range(rng.integers(1, 6)):
            inner = opened("div") if rng.random() < 0.4 else ""
            block(words(int(rng.integers(2, 9))), pick(["h4", "p", "li", ""]), False, rng.random() < 0.7)
            if rng.random() < 0.5:
                block(words(int(rng.integers(8, 30))), "p", False, rng.random() < 0.3)
            parts.append(inner)
        parts.append(end)

    def talk():
        """A discussion: each contribution in an element of its own, with a name and a date."""
        end = opened(pick(["section.comments", "div.comment-list", "ol.comments", "div#comments", "div.discussion"]) if telling else outside())
        if rng.random() < 0.6:
            block(words(2), pick(["h2", "h3", "p"]), False)
        for _ in range(rng.integers(1, 7)):
            inner = opened(pick(["div", "li", "article.comment"]) if telling else pick(["div", empty_name()]))
            if rng.random() < 0.8:
                block(words(int(rng.integers(1, 3))) + f" {rng.integers(1, 29)}.{rng.integers(1, 12)}.20{rng.integers(10, 25)}", pick(["div", "p", "h4"]), False)
            block(words(int(rng.integers(4, 40))), pick(["p", "p", "div"]), False)
            parts.append(inner)
        parts.append(end)

    def foot():
        end = opened("div.footer" if telling else outside())
        block(f"\u00a9 20{rng.integers(10, 25)} {words(2)}" if rng.random() < 0.6 else words(4), pick(["p", "", "li"]), False, rng.random() < 0.3)
        for _ in range(rng.integers(0, 4)):
            block(words(2), "li", False, True)
        parts.append(end)

    parts.append("<html><body>")
    depth = "".join(opened(pick(["div", "div.row", "div.wrapper", "section"])) for _ in range(int(rng.integers(0, 12)) if rng.random() < 0.4 else 0))
    for part in (menu, menu, rail):
        if rng.random() < 0.5:
            part()
    end = opened(inside())
    cut = sorted(int(k) for k in rng.integers(1, len(body) + 1, 2))
    inner = opened("div") if rng.random() < 0.3 else ""
    for k, t in enumerate(body):
        if k in cut and rng.random() < 0.25:  # something foreign within the text
            pick([rail, menu, foot])()
        block(t, pick(["h1", "h1", "h2", "p"]) if k == 0 else pick(["p", "p", "p", "p", "li", "h2", "blockquote"]), True)
    parts.append(inner)
    if rng.random() < 0.25:
        talk()
    parts.append(end)
    for part in (rail, talk, rail, menu, foot):
        if rng.random() < 0.5:
            part()
    return "".join(parts) + depth + "</body></html>", label


def windows(rng, n: int) -> list[slice]:
    """The parts of a page of ``n`` blocks to train on: all of it, or its start, its end and one part between."""
    if n <= TRAIN_BLOCKS:
        return [slice(0, n)]
    return [slice(a, a + TRAIN_BLOCKS) for a in (0, int(rng.integers(0, n - TRAIN_BLOCKS + 1)), n - TRAIN_BLOCKS)]


def fit(samples: list[str]) -> Labeller:
    rng = np.random.default_rng(6)
    cut = [b for b in map(blocks, samples) if b]
    texts = [b.text for page in cut for b in page] or ["text", "Some words of text."]
    pages, labels = [], []

    def add(page_blocks, y):
        x = vectors(page_blocks)
        for part in windows(rng, len(page_blocks)):
            pages.append(x[part])
            labels.append(np.array(y[part], np.float32))

    for page in cut:
        y = [float(marked(b.path)) for b in page]
        if any(y):
            add(page, y)
    for k in range(4 * max(len(cut), 20)):
        body = [b.text for b in cut[k % len(cut)] if marked(b.path)] if cut else []
        html, y = _page(rng, (body or [texts[int(rng.integers(len(texts)))] for _ in range(4)])[: 3 + int(rng.integers(28))], texts)
        made = blocks(html)
        if len(made) == len(y):
            add(made, y)
    return Labeller().train(pages, labels, max(EPOCHS, -(-STEPS * 32 // max(len(pages), 1))))


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    cut = [blocks(p) for p in pages]
    some = [i for i, b in enumerate(cut) if b]
    scores = dict(zip(some, model.scores([vectors(cut[i]) for i in some])))
    return ["\n".join(b.text for b, s in zip(page, scores[i]) if s >= 0.5) if page else "" for i, page in enumerate(cut)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row, repeated ones too; null html is an empty page with an empty text, an empty table
    gives no rows, and pages of any length are read whole. Narrow."""
    draw = F.xxhash64(F.lit(2), "page_id")
    n = max(pages.count(), 1)
    some = pages.where("html is not null").where(F.pmod(draw, F.lit(1_000_000)) < int(min(1.0, 3 * TRAIN_PAGES / n) * 1e6))
    model = fit([r[0] for r in some.orderBy(draw, "page_id").limit(TRAIN_PAGES).select("html").collect()])
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = main_texts(shipped.value, [h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
