"""HTML extraction: a bidirectional LSTM, in numpy, labels every text block of a page.

A page is read into its leaf blocks: runs of text between block-level tags, with character references decoded and white space
turned into single spaces. Each block is given to the network as the mean of learned vectors of its tag path (hashed names, classes and ids of
its open elements), the mean of learned vectors of its hashed words, and a few plain numbers (length, share of linked text, place). One LSTM reads the
blocks of the page forwards and one backwards; both states decide whether the block belongs to the main text, so every decision sees the whole page.

Training data are built here: generated pages of many layouts, whose main text is known, and a bounded sample of the given pages
whose semantic elements (article, main, nav, footer and the like) tell their blocks' labels. Scoring reads every block of every page.

Edge cases: null or empty pages, and pages without main blocks, give the empty text and 0 characters; unclosed or stray tags, cut-off
comments, scripts and references are read as browsers do, or as text; very long pages are one sequence like others; repeated rows repeat
their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm._spark import ship
from folioframe.llm._words import tidied, word_hashes

PATH_SLOTS, WORD_SLOTS, PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 1024, 1024, 12, 6, 6, 16
#: Bounds of the training set: generated pages, and given pages (of at most SAMPLE_CHARS each).
GENERATED, SAMPLE_PAGES, SAMPLE_CHARS = 900, 200, 50_000
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.01, 11
#: Blocks that are labelled at once.
RUN_BLOCKS = 20_000

# an attribute as browsers read it: a quote opens a value only right after the equals sign, and is part of other names and values
_ATTRIBUTE = re.compile(r"(=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)|(?=>)))?")
_ATTRIBUTES = r"(?:[\s/]+|" + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE.pattern) + ")*+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
# texts without tags, and elements whose content is no text of the page
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in "script style iframe textarea title".split()}
_HIDDEN = frozenset("svg select template noscript".split())
_END_OF = re.compile(r"</(template|noscript)(?=[\s/>])", re.I)
_SELF_CLOSED = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=]+)/\Z")
_NAME = re.compile(r"[a-z]+")
# fixed values: element names of HTML
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meta link q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = frozenset("ul ol dl table div article section main aside nav body form blockquote header footer".split())
_LEAVE_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_LEAVE_SELECT = _CLOSE_P - {"div", "hr"} | {"input", "textarea"}

class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = links = at = 0
    hidden: list[str] = []  # the element whose content is left out, and the open ones in it
    ends = {m[1].lower(): m.start() for m in _END_OF.finditer(page)}

    def still_hidden(name: str, closing: str, rest: str) -> bool:
        """Whether a tag in a hidden element leaves the page hidden or does no more than end that element."""
        kind, foreign = hidden[0], hidden[-1] not in ("foreignobject", "desc", "title")
        if kind in ("template", "noscript"):
            if name == kind:
                hidden.append(name) if not closing and kind == "template" else hidden.pop() if closing else None
                return True
            return not (closing and ends.get(kind, -1) < at and any(name == n for n, _ in stack))
        if closing and name in hidden:
            del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
            return True
        if closing:
            return not (any(name == n for n, _ in stack) or kind == "svg" and foreign and name in ("p", "br"))
        if kind == "select":
            if name == "select":
                hidden.clear()
            elif name not in _LEAVE_SELECT and name not in _VOID:
                hidden.append(name)
            return name not in _LEAVE_SELECT
        if foreign and name in _LEAVE_SVG:
            return False
        if name not in _VOID and not _SELF_CLOSED.search(rest):
            hidden.append(name)
        return True

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, tuple(x for _, names in stack for x in names), linked))
            held, linked = [], 0

    while m := _TOKEN.search(page, at):
        if m.start() > at and not hidden:
            piece = html_lib.unescape(page[at : m.start()])
            held.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        if m[2] is None:
            continue
        name, closing, rest = m[2].lower(), m[1], m[3]
        if hidden and still_hidden(name, closing, rest):
            if name in _RAW and not closing and hidden and hidden[0] != "svg":
                end = _RAW[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        hidden.clear()
        if name in _RAW and not closing:
            flush()
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _HIDDEN:
            if name != "svg":
                flush()
            if not closing and not (name == "svg" and _SELF_CLOSED.search(rest)) and not (name == "noscript" and ends.get(name, -1) < at):
                hidden.append(name)
            continue
        if name == "br":
            held.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        if name in _INLINE:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    links = 0
                    break
            continue
        if name in _CLOSE_P and stack and stack[-1][0] == "p":
            stack.pop()
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in _CLOSES.get(name, ()):
                del stack[k:]
                break
            if stack[k][0] in _STOPS:
                break
        if name not in _VOID:
            names = [name]
            for a in _ATTRIBUTE.finditer(rest):
                if a[1].lower() in ("class", "id", "role"):
                    names += [f"{a[1].lower()}.{w}" for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
            stack.append((name, tuple(names)))
    if at < len(page) and not hidden:
        held.append(html_lib.unescape(page[at:]))
    flush()
    return out


def _slot(name: str, kept: dict[str, int] = {}) -> int:  # noqa: B006  one table for the worker
    if name not in kept:
        if len(kept) > 100_000:
            kept.clear()
        h = 2166136261
        for b in name.encode():
            h = (h ^ b) * 16777619 % 2**32
        kept[name] = (h ^ h >> 15) % PATH_SLOTS
    return kept[name]


class Inputs:
    """Numbers for the blocks of several pages, one after the other."""

    def __init__(self, pages: list[list[Block]]):
        flat = [b for p in pages for b in p]
        self.sizes = np.array([len(p) for p in pages], np.int64)
        self.paths = np.fromiter((_slot(x) for b in flat for x in b.path), np.int64)
        self.path_count = np.fromiter((len(b.path) for b in flat), np.int64, len(flat))
        hashes, off = word_hashes([b.text.encode("utf-8", "replace") for b in flat]) if flat else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.words, self.word_count = (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), np.diff(off)
        length = np.fromiter((len(b.text) for b in flat), np.float64, len(flat))
        linked = np.fromiter((b.linked for b in flat), np.float64, len(flat))
        first = np.cumsum(self.sizes) - self.sizes
        place = (np.arange(len(flat)) - np.repeat(first, self.sizes) + 0.5) / np.maximum(np.repeat(self.sizes, self.sizes), 1)
        ends = np.fromiter((b.text[-1] in ".!?…:" for b in flat), np.float64, len(flat))
        self.numbers = np.stack([np.log1p(length) / 8, np.minimum(linked / np.maximum(length, 1), 1), place, 1 - place, ends, np.log1p(self.word_count) / 6], 1)

    @staticmethod
    def mean(table: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Mean of table rows for each run of ``count`` places."""
        sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[at], axis=0)])
        ends = np.cumsum(count)
        return (sums[ends] - sums[ends - count]) / np.maximum(count, 1)[:, None]


class Labeller:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + NUMBERS
        self.path = rng.normal(0, 0.5, (PATH_SLOTS, PATH_DIM))
        self.word = rng.normal(0, 0.3, (WORD_SLOTS, WORD_DIM))
        self.gates = rng.normal(0, 0.25, (2, d + HIDDEN, 4 * HIDDEN))
        self.shift = np.zeros((2, 4 * HIDDEN))
        self.shift[:, HIDDEN : 2 * HIDDEN] = 1
        self.out = rng.normal(0, 0.3, (2 * HIDDEN + d,))
        self.bias = np.zeros(1)

    def _params(self) -> list[np.ndarray]:
        return [self.path, self.word, self.gates, self.shift, self.out, self.bias]

    def _lstm(self, x: np.ndarray, side: int) -> tuple[np.ndarray, list]:
        """States for x (time, pages, inputs)."""
        steps_, n, _ = x.shape
        w, h, c = self.gates[side], np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, kept = np.empty((steps_, n, HIDDEN)), []
        given = x @ w[: x.shape[2]] + self.shift[side]
        recurrent = w[x.shape[2] :]
        for t in range(steps_):
            z = given[t] + h @ recurrent
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            kept.append((h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = h
        return out, kept

    def _laid_out(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks (rows) as time x pages, forwards and backwards, padded at the end; time and page of each block."""
        n, most = len(sizes), int(sizes.max())
        page = np.repeat(np.arange(n), sizes)
        time = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        back = np.repeat(sizes, sizes) - 1 - time
        ahead, behind = np.zeros((most, n, x.shape[1])), np.zeros((most, n, x.shape[1]))
        ahead[time, page], behind[back, page] = x, x
        return ahead, behind, time, page

    def _forward(self, q: Inputs) -> tuple:
        x = np.concatenate([q.mean(self.path, q.paths, q.path_count), q.mean(self.word, q.words, q.word_count), q.numbers], 1)
        sizes = q.sizes[q.sizes > 0]
        ahead, behind, time, page = self._laid_out(x, sizes)
        back = np.repeat(sizes, sizes) - 1 - time
        a, kept_a = self._lstm(ahead, 0)
        b, kept_b = self._lstm(behind, 1)
        state = np.concatenate([a[time, page], b[back, page], x], 1)
        return state @ self.out + self.bias[0], state, (ahead, behind, time, back, page, kept_a, kept_b)

    def main(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which blocks are main text. Pages of similar length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and (e + 1 - s) * len(pages[order[e]]) <= RUN_BLOCKS:
                e += 1
            own = order[s:e]
            logit = self._forward(Inputs([pages[k] for k in own]))[0]
            cuts = np.cumsum([len(pages[k]) for k in own])[:-1]
            for k, v in zip(own, np.split(logit > 0, cuts)):
                out[k] = v
            s = e
        return out

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray]) -> None:
        rng = np.random.default_rng(SEED)
        params = self._params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for epoch in range(EPOCHS):
            order = sorted(range(len(pages)), key=lambda k: (len(pages[k]) // 8, rng.random()))
            runs = [order[s : s + BATCH] for s in range(0, len(order), BATCH)]
            for r in rng.permutation(len(runs)):
                own = runs[r]
                grads = self._gradients(Inputs([pages[k] for k in own]), np.concatenate([labels[k] for k in own]).astype(float))
                t += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _spread(g: np.ndarray, at: np.ndarray, count: np.ndarray, slots: int) -> np.ndarray:
        """Gradients of a table of vectors, of whose rows ``at`` runs of ``count`` were averaged."""
        each = np.repeat(g / np.maximum(count, 1)[:, None], count, axis=0)
        return np.stack([np.bincount(at, each[:, d], slots) for d in range(g.shape[1])], 1)

    def _gradients(self, q: Inputs, y: np.ndarray) -> list[np.ndarray]:
        logit, state, (ahead, behind, time, back, page, kept_a, kept_b) = self._forward(q)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        g_state = d[:, None] * self.out
        g_x = g_state[:, 2 * HIDDEN :].copy()
        g_gates, g_shift = np.zeros_like(self.gates), np.zeros_like(self.shift)
        width = ahead.shape[2]
        for side, (x, kept, at) in enumerate(((ahead, kept_a, time), (behind, kept_b, back))):
            g_out = np.zeros((*x.shape[:2], HIDDEN))
            g_out[at, page] = g_state[:, side * HIDDEN : (side + 1) * HIDDEN]
            w, g_in = self.gates[side], np.zeros_like(x)
            dh, dc = np.zeros(x.shape[1:2] + (HIDDEN,)), np.zeros(x.shape[1:2] + (HIDDEN,))
            for t in range(len(x) - 1, -1, -1):
                h, c, i, f, o, g = kept[t]
                now = f * c + i * g
                th = np.tanh(now)
                dh = dh + g_out[t]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
                g_gates[side] += np.concatenate([x[t], h], 1).T @ dz
                g_shift[side] += dz.sum(0)
                both = dz @ w.T
                g_in[t], dh, dc = both[:, :width], both[:, width:], dc * f
            g_x += g_in[at, page]
        g_path = self._spread(g_x[:, :PATH_DIM], q.paths, q.path_count, PATH_SLOTS)
        g_word = self._spread(g_x[:, PATH_DIM : PATH_DIM + WORD_DIM], q.words, q.word_count, WORD_SLOTS)
        return [g_path, g_word + 1e-5 * self.word, g_gates, g_shift, state.T @ d, np.array([d.sum()])]


# fixed values: names that pages give to the parts around their main text
_AROUND = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead topbar branding sitehead",
    "footer": "footer colophon copyright legal bottom",
    "aside": "sidebar aside widget related recommended trending popular rail more",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner promoted outbrain",
    "notice": "cookie consent notice alert gdpr popup modal overlay newsletter subscribe signup paywall",
    "form": "form search login contact signin",
    "comments": "comments comment reply replies discussion respond disqus",
    "share": "share social sharing follow tools",
}
_AROUND_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form"], "comments": ["section", "div"], "ad": ["div", "aside"], "notice": ["div", "section"], "share": ["div", "ul"]}
_MAIN = "article content post entry story body text main page document prose"
_OFF = frozenset(x for names in _AROUND.values() for x in names.split() if x not in ("more", "text", "page", "tabs", "tools", "bottom"))
_SAID = {"ad": "advertisement buy now sale offer sponsored", "notice": "we use cookies accept privacy policy subscribe to our newsletter", "footer": "© all rights reserved terms privacy contact", "comments": "reply says said comment like", "share": "share tweet email print", "form": "search submit name email password"}


def generated(seed: int, n: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Pages of many layouts with known labels. Main words carry the mark character U+E000 until the page is read."""
    rng = random.Random(seed)
    sounds = [a + b for a in ("", *"bcdfghklmnprstvwz", "th", "sh", "ch") for b in "aeiou"] + list("äöüéèñç")

    pick = rng.choice

    def words(least: int, most: int, said: str = "") -> str:
        out = ["".join(pick(sounds) for _ in range(rng.randrange(1, 5))) + pick(["", "", "", "", "", ",", ".", "."]) for _ in range(rng.randrange(least, most))]
        if said and rng.random() < 0.6:
            out[:0] = said.split()[: rng.randrange(2, 6)]
        return " ".join(out).capitalize() + pick([".", ".", "", "!"])

    def named(tag: str, names: str, certain: float) -> tuple[str, str]:
        mark = f' {pick(["class", "class", "id"])}="{pick(["", "", "site-", "block-"])}{pick(names.split())}{pick(["", "", " box", " wide"])}"' if rng.random() < certain else ""
        return f"<{tag}{mark}>", f"</{tag}>"

    def around(kind: str) -> str:
        tag = pick(_AROUND_TAGS[kind])
        a, b = named(tag, _AROUND[kind], 0.35 if tag == kind else 0.97)
        if kind in ("nav", "share") or (kind in ("aside", "footer") and rng.random() < 0.5):
            item = "li" if tag == "ul" or rng.random() < 0.7 else "span"
            inner = "".join(f'<{item}><a href="/x">{words(1, 4)}</a></{item}>' for _ in range(rng.randrange(2, 9)))
            inner = f"<ul>{inner}</ul>" if item == "li" and tag != "ul" else inner
        elif kind == "comments":
            inner = "".join(f'<{pick(["div", "p", "li"])}>{words(5, 60, _SAID[kind])}' for _ in range(rng.randrange(1, 6)))
        elif kind == "form":
            inner = f"<label>{words(1, 3, _SAID[kind])}</label><input name=q><button>{words(1, 3)}</button>"
        else:
            inner = pick(["{}", "<p>{}</p>", "<p>{}</p><p>{}</p>", "<h3>{}</h3>{}"]).replace("{}", words(2, 25, _SAID.get(kind, "")))
        return a + inner + b

    pages, labels = [], []
    for _ in range(n):
        a, b = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("", ""), ('<div role="main">', "</div>"), named("div", _MAIN, 1.0), named("div", _MAIN, 1.0), named("section", _MAIN, 1.0), named("article", _MAIN, 1.0)])
        inner = []
        if rng.random() < 0.8:
            level = pick(["h1", "h1", "h2"])
            inner.append(f"<{level}>\ue000{words(2, 12)}</{level}>")
        for _ in range(rng.randrange(1, 25)):
            kind = rng.random()
            long = words(4, pick([12, 40, 150]))
            if kind < 0.78:
                inner.append(pick(["<p>\ue000{}</p>", "<p>\ue000{}</p>", "<p><b>\ue000{}<br>", "<p>\ue000{}", "<div>\ue000{}</div>"]).replace("{}", long))
            elif kind < 0.86:
                inner.append("<ul>" + "".join(f"<li>\ue000{words(2, 20)}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
            elif kind < 0.92:
                inner.append(f"<{pick(['h2', 'h3', 'h4'])}>\ue000{words(1, 8)}</h3>".replace("</h3>", ""))
            elif kind < 0.95:
                inner.append(pick([f"<blockquote><p>\ue000{long}</p></blockquote>", f"<blockquote>\ue000{long}</blockquote>", f"<pre>\ue000{words(1, 9)}</pre>", f"<dl><dt>\ue000{words(1, 4)}<dd>\ue000{words(3, 20)}</dl>"]))
            else:
                inner.append("<table>" + pick(["", f"<tr><th>\ue000{words(1, 3)}</th><th>\ue000{words(1, 3)}</th></tr>"]) + "".join(f"<tr><td>\ue000{words(1, 5)}</td><td>\ue000{words(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            if rng.random() < 0.1:
                inner[-1] = f'<{pick(["section", "div"])} id="{pick(sounds)}{pick(sounds)}">{inner[-1]}</{pick(["section", "div"])}>'
        for kind in ("ad", "share", "aside", "notice"):
            if rng.random() < 0.12:
                inner.insert(rng.randrange(len(inner) + 1), around(kind))
        before = [around(k) for k in ("notice", "header", "nav", "ad", "nav", "aside") if rng.random() < 0.45]
        after = [around(k) for k in ("share", "comments", "aside", "ad", "form", "notice", "footer") if rng.random() < 0.4]
        wrap = pick([("", ""), ('<div class="wrapper">', "</div>"), ('<div id="container"><div class="row">', "</div></div>")])
        page = "<html><head><title>x</title></head><body>" + "".join(before) + wrap[0] + a + "".join(inner) + b + wrap[1] + "".join(after) + "</body></html>"
        found = blocks(page)
        labels.append(np.array([x.text.startswith("\ue000") for x in found]))
        for x in found:
            x.text = x.text.lstrip("\ue000") or "."
        pages.append(found)
    return pages, labels


def told_by_elements(found: list[Block]) -> np.ndarray | None:
    """Labels of a page that has an article or main element: inside it, and in nothing that is named as around it."""
    if not any(x in ("article", "main") for b in found for x in b.path):
        return None
    off = _OFF | {"nav", "footer", "aside", "form", "header"}
    return np.array([any(x in ("article", "main") for x in b.path) and not any(x.rpartition(".")[2] in off for x in b.path) for b in found])


def train(pages: list[str]) -> Labeller:
    """A network from generated pages and the given sample."""
    found, labels = generated(SEED, GENERATED)
    for page in pages:
        own = blocks(page)
        said = told_by_elements(own)
        if said is not None:
            found.append(own)
            labels.append(said)
    net = Labeller()
    keep = [k for k in range(len(found)) if found[k]]
    net.fit([found[k] for k in keep], [labels[k] for k in keep])
    return net


def extract(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """``id_cols, text, n_chars, n_blocks, n_main`` of every page."""
    spark = df.sparkSession
    ship(spark)
    page = F.coalesce(F.col(html_col), F.lit(""))
    # the pages of lowest hash: hashes are ranked first, so that only the chosen pages leave their tasks
    ranked = df.where(F.length(page).between(1, SAMPLE_CHARS)).select(F.xxhash64(page).alias("x"), page.alias("h"))
    edge = ranked.select("x").distinct().orderBy("x").limit(sample).agg(F.max("x")).first()[0]
    seen = ranked.where(F.col("x") <= F.lit(edge)).groupBy("x").agg(F.first("h").alias("h")).orderBy("x").collect()
    shared = spark.sparkContext.broadcast(train([r["h"] for r in seen]))
    rows = df.select(page.alias("_html"), *id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm import html_lstm as m

        for batch in tidied(batches):
            texts, counts, mains = [], [], []
            held, size = [], 0
            for k, h in enumerate(batch.column(0).to_pylist()):
                held.append(m.blocks(h))
                size += len(h)
                if size > 1 << 23 or k == batch.num_rows - 1:
                    for found, main in zip(held, shared.value.main(held)):
                        texts.append("\n".join(b.text for b, x in zip(found, main) if x))
                        counts.append(len(found))
                        mains.append(int(main.sum()))
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(mains, pa.int64())], [*batch.schema.names[1:], "text", "n_chars", "n_blocks", "n_main"])

    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{sql}, text string, n_chars long, n_blocks long, n_main long")
