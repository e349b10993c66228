"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags.  Each
block is a vector: its hashed tag path (tags, classes, ids), its hashed words,
and a few measures.  A bidirectional LSTM in numpy reads the blocks of a page in
order, both ways, and labels each as main text or not, so every label sees the
whole page.

It is trained here, on at most TRAIN pages of the input (those with the least
hash of their id).  The block labels come from the pages' own markup; since
sites mark up content in many ways, each training page is also laid out anew in
frames of other sites (FRAMES, FURNITURE), with running text in the furniture,
so that places and neighbours tell, not words.

Null or empty html, or a page without main text, gives empty text of 0
characters.  White space is what str.split takes for it.  Unclosed tags and
broken markup are read as browsers do, roughly: nothing is cut off.  A page is
judged alone, so repeated rows get equal results.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training pages at most, blocks and main paragraphs of each that are trained on, and sizes of the vectors and of the LSTM's state.
TRAIN, BLOCKS, BODY, PATHS, WORDS, HIDDEN = 200, 80, 20, 256, 24, 16
#: Pages laid out anew at least.
LEAST = 600
MEASURES = 8

# Tags by what they do to text.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "object", "textarea"}
# of these, what hides nothing where it is not closed
OPEN = {"svg", "object", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FRAMES = ['<article>{}</article>', '<main>{}</main>', '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<section class="post">{}</section>', '<div class="entry-content">{}</div>', '<div class="article-body"><div>{}</div></div>', '<div role="main" id="story">{}</div>', '<main><article class="post">{}</article></main>', '<div class="txt">{}</div>', '<div>{}</div>', '<table><tr><td>{}</td></tr></table>', '{}', '<div class="page"><div class="col">{}</div></div>']
# how a paragraph of main text may be marked up
PARTS = ['<p>{t}</p>', '<p>{t}</p>', '<p>{t}</p>', '<ul><li>{t}</li><li>{s}</li></ul>', '<blockquote>{t}</blockquote>', '<table><tr><th>{s}</th><th>{s}</th></tr><tr><td>{s}</td><td>{t}</td></tr></table>', '<pre>{t}</pre>', '<h2>{s}</h2><p>{t}</p>', '<div>{t}</div>', '<dl><dt>{s}</dt><dd>{t}</dd></dl>', '<figure><figcaption>{s}</figcaption></figure>']
FURNITURE = ['<nav><ul>{li}</ul></nav>', '<ul class="menu">{li}</ul>', '<header><div class="logo">{t}</div></header>', '<header class="site-header"><p>{t}</p></header>', '<aside><p>{p}</p><p>{t}</p></aside>', '<div class="sidebar"><h3>{t}</h3><p>{p}</p></div>', '<div class="ad">{t}</div>', '<div class="advert"><p>{p}</p></div>', '<div class="promo banner">{p}</div>', '<div class="cookie-notice"><p>{p}</p></div>', '<div class="notice">{p}</div>', '<form><label>{t}</label><p>{t}</p><button>{t}</button></form>', '<div class="comments"><h2>{t}</h2><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p></div></div>', '<section id="comments"><p>{p}</p><p>{p}</p></section>', '<div class="related"><ul>{li}</ul></div>', '<div class="newsletter">{t}</div>', '<div class="share">{t}</div>', '<footer><p>{p}</p></footer>', '<footer>{t}</footer>', '<div class="footer">{t}</div>']
MAIN_TAGS = {"article", "main"}
OTHER_TAGS = {"head", "title", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog"}
OTHER_NAMES = re.compile(r"\b(ad|ads|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|sidebar|footer|header|cookie\S*|notice|comments?|related|newsletter|share|social|popup)\b")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
MARK, NAME_END = re.compile("[>\"']"), re.compile(r"[\s/>]")
NAMES = re.compile(r"(?:\s|^)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Blocks of a group of pages that are labelled together, each page counted as long as the longest; a longer page is alone.
CELLS = 1 << 14


class Tokens:
    """Tags and comments of a page from left to right, in time that grows with the page, however broken it is.

    A ``<`` begins a tag if an unquoted ``>`` follows.  After the first that doesn't,
    it is worked out for all places, from the right, over the marks ``>``, ``"`` and ``'``.
    """

    def __init__(self, html: str) -> None:
        self.html, self.last, self.stop = html, html.rfind(">"), -1
        self.places: list[int] | None = None

    def _look_ahead(self) -> None:
        html = self.html
        self.places = [m.start() for m in MARK.finditer(html)]
        # does reading on from mark k, outside quotes or inside either kind, reach an unquoted >
        n = len(self.places)
        self.plain, double, single = bytearray(n + 1), 0, 0
        for k in range(n - 1, -1, -1):
            c, ahead = html[self.places[k]], self.plain[k + 1]
            self.plain[k] = 1 if c == ">" else double if c == '"' else single
            double, single = (ahead if c == '"' else double), (ahead if c == "'" else single)

    def _name_ends(self, at: int) -> int:
        if self.stop < at:
            m = NAME_END.search(self.html, at)
            self.stop = m.start() if m else len(self.html)
        return self.stop

    def next(self, at: int) -> re.Match | None:
        """The first token from there on."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if self.places is None:
                if m := TOKEN.match(html, at):
                    return m
                self._look_ahead()
            first = html[at + 1 : at + 2]
            if html.startswith("<!--", at) or first in ("!", "?") and self.last > at:
                return TOKEN.match(html, at)
            name = at + 1 + (first == "/")
            if first and html[name : name + 1].isascii() and html[name : name + 1].isalpha() and self.plain[bisect_left(self.places, self._name_ends(name))]:
                return TOKEN.match(html, at)
            at += 1
        return None


def closes_itself(attributes: str) -> bool:
    """Whether a tag ends in a slash that isn't the end of a value without quotes, as in ``href=/``."""
    tail = attributes.rstrip()
    if not tail.endswith("/"):
        return False
    last = tail.rsplit(None, 1)[-1]
    return "=" not in last or last[-2] in "\"'"


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def blocks(html: str | None) -> list[Block]:
    """The page's blocks in order: decoded text with single spaces, and the open tags around it as ``tag.names``."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, where, at, begun = 0, (), 0, False
    tokens, unclosed, opened = Tokens(html), set(), Counter()

    def text(raw: str) -> None:
        nonlocal linked, where, begun
        if raw and not raw.isspace():
            if not begun:
                where, begun = tuple(x for _, x in stack), True
            if opened["a"]:
                linked += len(raw)
        parts.append(raw)

    def flush() -> None:
        nonlocal linked, begun
        if t := " ".join(unescape("".join(parts)).split()):
            out.append(Block(tuple(p for p in where if p.partition(".")[0] not in INLINE), t, linked))
        parts.clear()
        linked, begun = 0, False

    def close(i: int) -> None:
        opened.subtract(t for t, _ in stack[i:])
        del stack[i:]

    while m := tokens.next(at):
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag == "svg" and closes_itself(m[3]):
            continue
        if tag in RAW:
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if not end:
                unclosed.add(tag)
            if end or tag not in OPEN:
                at = end.end() if end else len(html)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
        else:
            flush()
            if (shut := CLOSED_BY.get(tag)) and any(opened[x] for x in shut):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in shut:
                        close(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] not in shut:
                        break
        if tag not in VOID and not closes_itself(m[3]):
            names = " ".join(next(v for v in x[1:] if v or v == x[-1]) for x in NAMES.findall(m[3])).lower() if m[3] else ""
            stack.append((tag, f"{tag}.{names}" if names else tag))
            opened[tag] += 1
    text(html[at:])
    flush()
    return out


def looks_main(path: tuple[str, ...]) -> bool:
    """The label that a page's markup gives: for training only."""
    tags = {p.partition(".")[0] for p in path}
    return bool(tags & MAIN_TAGS) and not tags & OTHER_TAGS and not any(OTHER_NAMES.search(p.partition(".")[2]) for p in path)


# words of names in layouts that are made up; half of the names are letters and digits only
PLACES = "wrap wrapper box inner outer page col left right mid center top bottom bar row grid cell area zone block part unit container layout body text story".split()
TALK = "comments comment discussion replies responses thread feedback remarks reactions talk".split()


class Layouts:
    """Pages laid out by a grammar: names, depths and what stands before and after the main text are drawn, so that training meets few names twice."""

    def __init__(self, rng: np.random.Generator, pick: Callable[[], str]) -> None:
        self.rng, self.pick = rng, pick

    def _one(self, of: list):
        return of[self.rng.integers(len(of))]

    def name(self, words: list[str] = PLACES) -> str:
        made = self._one(words) if self.rng.random() < 0.5 else "".join(self._one(list("abcdefghijklmnopqrstuvwxyz")) for _ in range(self.rng.integers(1, 7)))
        made += self._one(["", "", str(self.rng.integers(1, 12)), "-" + self._one(PLACES)])
        return self._one([f' class="{made}"', f' id="{made}"', f" id={made}", ""])

    def wrap(self, inner: str, depth: int) -> str:
        for _ in range(depth):
            tag = self._one(["div", "div", "div", "section"])
            inner = f"<{tag}{self.name()}>{inner}</{tag}>"
        return inner

    def _short(self) -> str:
        return " ".join(self.pick().split()[: self.rng.integers(1, 5)])

    def _links(self) -> str:
        item = self._one(["<li><a href='/'>{}</a></li>", "<a href='/'>{}</a> ", "<p><a href='/'>{}</a></p>", "<a href='/'>{}</a><br>"])
        made = "".join(item.format(self._short()) for _ in range(self.rng.integers(1, 7)))
        return f"<ul>{made}</ul>" if item.startswith("<li") else made

    def furniture(self) -> str:
        inner = self._one([self._links, self._links, self._short, lambda: f"<p>{self._short()}</p>", lambda: f"<h3>{self._short()}</h3>{self._links()}"])()
        return self.wrap(inner, int(self.rng.integers(1, 3)))

    def talk(self) -> str:
        item = self._one(["<p>{}</p>", "<div>{}</div>", "<div class='c'><p>{}</p></div>", "<li>{}</li>"])
        made = "".join(item.format(self.pick()[:400]) for _ in range(self.rng.integers(1, 5)))
        head = f"<h3>{self._short()}</h3>" if self.rng.random() < 0.5 else ""
        tag = self._one(["div", "section"])
        return f"<{tag}{self._one([' class=', ' id='])}\"{self._one(TALK)}\">{head}{made}</{tag}>"

    def page(self, main: str) -> str:
        """A bare page now and then; else furniture around the main text, in a table at times, and talk behind it."""
        if self.rng.random() < 0.25:
            return self.wrap(main, int(self.rng.integers(0, 2)))
        several = lambda: [self.furniture() for _ in range(self.rng.integers(0, 4))]
        before, after = several(), several()
        if self.rng.random() < 0.35:
            after.insert(0, self.talk())
        if self.rng.random() < 0.15:
            return "<table><tr>" + "".join(f"<td>{x}</td>" for x in (*before, main, *after)) + "</tr></table>"
        return self.wrap("".join(before) + self.wrap(main, int(self.rng.integers(1, 4))) + "".join(after), int(self.rng.integers(0, 2)))


def vector(b: Block, i: int, n: int, shares: tuple[float, float], cache: dict) -> np.ndarray:
    if (p := cache.get(b.path)) is None:
        p = np.zeros(PATHS, np.float32)
        for up, part in enumerate(reversed(b.path[-8:])):
            tag, _, names = part.partition(".")
            for token in (tag, *re.findall(r"[a-z0-9]+", names)):
                p[zlib.crc32(f"{token}".encode()) % (PATHS - 16)] += 1
            if up < 2:
                p[PATHS - 16 + zlib.crc32(f"{up} {tag}".encode()) % 16] += 1
        if len(cache) > 5000:
            cache.clear()
        cache[b.path] = p
    words = b.text.split(" ")
    bag = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS) / len(words)
    measures = [np.log1p(len(b.text)) / 4, 3 * b.linked / max(len(b.text), 1), sum(map(b.text.count, ".,;:!?")) / len(words), np.log1p(len(words)) / 2, i / n, *shares, 1.0]
    return np.concatenate((p, bag, measures)).astype(np.float32)


SIZE = PATHS + WORDS + MEASURES


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output on both states."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, SIZE**-0.5, (SIZE, 4 * HIDDEN)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w[f"c{d}"] = np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)
        self.w["o"] = rng.normal(0, HIDDEN**-0.5, 2 * HIDDEN).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States over time; x is (time, pages, SIZE), already in this direction's order."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        inputs = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        out, trace = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            z = inputs[t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                trace.append((h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            out[t] = h
        return out, trace

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, _ = self._run(x, mask, "f", False)
        hb, _ = self._run(x[::-1], mask[::-1], "b", False)
        return np.concatenate((hf, hb[::-1]), 2) @ self.w["o"] + self.w["ob"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the blocks of a batch, through time."""
        hf, tf = self._run(x, mask, "f", True)
        hb, tb = self._run(x[::-1], mask[::-1], "b", True)
        both = np.concatenate((hf, hb[::-1]), 2)
        dz = (_sigmoid(both @ self.w["o"] + self.w["ob"]) - y) * mask / mask.sum()
        grads = {"o": (both * dz[..., None]).sum((0, 1)), "ob": np.array([dz.sum()])}
        down = dz[..., None] * self.w["o"]
        for d, xs, dh_out, trace in (("f", x, down[..., :HIDDEN], tf), ("b", x[::-1], down[::-1, :, HIDDEN:], tb)):
            dx, dh_w = np.zeros((len(xs), xs.shape[1], 4 * HIDDEN), np.float32), np.zeros_like(self.w[f"h{d}"])
            dh = dc = np.zeros((xs.shape[1], HIDDEN), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                h, c, i, f, o, g, tc, m = trace[t]
                dh = dh + dh_out[t]
                on, dcn = dh * m, dc * m
                dct = dcn + on * o * (1 - tc * tc)
                z = np.concatenate((dct * g * i * (1 - i), dct * c * f * (1 - f), on * tc * o * (1 - o), dct * i * (1 - g * g)), 1)
                dx[t] = z
                dh_w += h.T @ z
                dh = z @ self.w[f"h{d}"].T + dh * ~m
                dc = dct * f + dc * ~m
            grads[f"h{d}"] = dh_w
            grads[f"x{d}"] = np.einsum("tbs,tbg->sg", xs, dx, optimize=True)
            grads[f"c{d}"] = dx.sum((0, 1))
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                some = [pages[i] for i in order[a : a + batch]]
                x, mask = padded([v for v, _ in some])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, label) in enumerate(some):
                    y[: len(label), k] = label
                step += 1
                for k, g in self.gradient(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    long = max(map(len, pages))
    x, mask = np.zeros((long, len(pages), SIZE), np.float32), np.zeros((long, len(pages)), bool)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


def vectors(page: list[Block], cache: dict) -> np.ndarray:
    """A row a block; among its measures the share of the page's text in blocks of the same place, and in places under the same parent."""
    own, up = Counter(), Counter()
    for b in page:
        own[b.path] += len(b.text) - b.linked
        up[b.path[:-1]] += len(b.text) - b.linked
    total = max(1, sum(own.values()))
    share = lambda b: (own[b.path] / total, up[b.path[:-1]] / total)
    return np.array([vector(b, i, len(page), share(b), cache) for i, b in enumerate(page)], np.float32).reshape(-1, SIZE)


def training(pages: list[str], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of pages, as they are where their markup tells what is main, and laid out anew; blocks past BLOCKS are left to use, not to training."""
    rng, cache = np.random.default_rng(seed), {}
    read = [b for b in map(blocks, pages) if b]
    marked = [b for b in read if any(looks_main(x.path) for x in b)]
    out = [(vectors(b[:BLOCKS], cache), np.array([looks_main(x.path) for x in b[:BLOCKS]], np.float32)) for b in marked]
    texts = [x.text for b in read for x in b if len(x.text) > 20] or ["text"]
    mains = [x.text for b in marked for x in b if len(x.text) > 20 and looks_main(x.path)] or texts
    plain = lambda t: t.replace("<", "").replace("&", "")
    pick = lambda: plain(texts[rng.integers(len(texts))])
    layouts = Layouts(rng, lambda: plain(mains[rng.integers(len(mains))]))
    for k in range(max(6, -(-2 * LEAST // max(1, len(read))))):
        for b in read:
            body = [plain(x.text) for x in b if looks_main(x.path)][:BODY] or [layouts.pick() for _ in range(3)]
            title = f"<html><head><title>{body[0][:60]}</title></head><body>"
            if k % 2:
                body = body[: rng.integers(1, 7)]
                inner = (f"<h1>{body[0][:80]}</h1>" if rng.random() < 0.5 else "") + "".join(PARTS[0 if rng.random() < 0.7 else rng.integers(len(PARTS))].replace("{t}", t).replace("{s}", pick()[:40]) for t in body)
                page = blocks(f"{title}{layouts.page('@@1' + inner + '@@2')}</body></html>")
            else:
                part = lambda t: PARTS[rng.integers(len(PARTS))].replace("{t}", t).replace("{s}", pick()[:40])
                inner = f"<h1>{body[0][:80]}</h1>" + "".join(map(part, body))
                some = [FURNITURE[i] for i in rng.permutation(len(FURNITURE))[: rng.integers(3, 8)]]
                made = [f.replace("{li}", "".join(f"<li><a href='/'>{pick()[:25]}</a></li>" for _ in range(4))) for f in some]
                made = [re.sub(r"\{([tp])\}", lambda m: pick()[: 40 if m[1] == "t" else 400], f) for f in made]
                inside = made.pop() if rng.random() < 0.3 else ""
                cut = int(rng.integers(len(made) + 1))
                page = blocks(f"{title}{''.join(made[:cut])}{FRAMES[rng.integers(len(FRAMES))].format('@@1' + inner + '@@2' + inside)}{''.join(made[cut:])}</body></html>")
            label, on = [], False
            for x in page:
                on |= x.text.startswith("@@1")
                x.text, here = x.text.replace("@@1", ""), on and not x.text.startswith("@@2")
                if "@@2" in x.text:
                    on, x.text = False, x.text.replace("@@2", "")
                label.append(here and bool(x.text))
            keep = [k for k, x in enumerate(page) if x.text]
            page, label = [page[k] for k in keep][:BLOCKS], np.array([label[k] for k in keep][:BLOCKS], np.float32)
            out.append((vectors(page, cache), label))
    return out


def train(pages: DataFrame, bound: int = TRAIN) -> Labeller:
    rows = pages.where("html is not null").select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(bound).collect()
    return Labeller().fit(training([r.html for r in rows])) if rows else Labeller()


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = pages.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                read = [blocks(h) for h in part.column("html").to_pylist()]
                text = [""] * len(read)
                some = sorted((i for i, x in enumerate(read) if x), key=lambda i: len(read[i]))
                while some:  # pages of like length together, the longest first
                    fit = max(1, min(32, CELLS // len(read[some[-1]])))
                    group, some = some[-fit:], some[:-fit]
                    x, mask = padded([vectors(read[i], cache) for i in group])
                    yes = known.value.scores(x, mask) > 0
                    for j, i in enumerate(group):
                        text[i] = "\n\n".join(blk.text for t, blk in enumerate(read[i]) if yes[t, j])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")
