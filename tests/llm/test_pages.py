"""URL rules, main text extraction, chat trees, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from sigmark.llm import chat, html, queries, urls
from tests.conftest import DATA


def plain(url, rules, listed):
    host, path = urls.split_url(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(host == x or host.endswith("." + x) for x in listed) else "allow"


def test_urls(spark):
    texts = [None, "", "no scheme", "http://", "http://COM", "https://A.Example.com/en/x?y#z", "http://www.example.com/en/", "http://example.com/enx", "https://x.net/es/1", "http://net/fr/", "ftp://casino-win.example.org", "http://m.casino-win.example.org/?q", "http://notnet/es/", "http://h.org#f/en", "x://b.example.com:80/en/"]
    rows = [(i, u, "x") for i, u in enumerate(texts)] + [(5, texts[5], "x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), queries.URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == plain(texts[r.page_id], queries.URL_RULES, urls.BAD_HOSTS), texts[r.page_id]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).collect() == []


def test_digests_that_collide(spark):
    name = urls.publish(spark, [("block", "a.com", "/")], ["b.org"])
    table = urls.Digests(name)
    assert table.probe(["a.com/", "b.org/", "c.org/"]) == [urls.BLOCK, urls.LISTED, None]
    table.entry = lambda k: "other"
    assert table.probe(["a.com/", "b.org/"]) == [None, None]


def test_listed_entries_from_a_table(spark):
    listed = spark.createDataFrame([("bad.org",), ("good.org/x",), ("bad.org",), (None,), ("com",)], "host string")
    pages = spark.createDataFrame([(0, "http://a.bad.org/q"), (1, "http://good.org/xy"), (2, "http://good.org/z"), (3, "http://x.com/"), (4, "http://" + "a." * 300 + "bad.org/" + "p" * 5000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, queries.URL_RULES, listed).collect()}
    assert got == {0: (None, "block"), 1: (None, "block"), 2: (None, "allow"), 3: ("com/", "allow"), 4: (None, "block")}


def test_blocks():
    page = "<p>One &amp; <b>two</b><br>three<p>four<script>var x='</p>';</script><!-- no --><ul><li>a<li>b</ul>tail &lt;"
    assert [b.text for b in html.blocks(page)] == ["One & two three", "four", "a", "b", "tail <"]
    assert html.blocks(None) == []


def test_raw_tags_without_an_end_hide_nothing():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<p>one<svg width='1'/>two<p>three<svg><text>no</text></svg> four") == ["onetwo", "three four"]
    for tag in ("svg", "object", "noscript"):
        assert texts(f"<p>one</p><{tag}><p>two</p>") == ["one", "two"]
    assert texts("<p>one</p><script>var x") == ["one"]


def test_gradient():
    rng = np.random.default_rng(0)
    m = html.Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, mask = html.padded([rng.normal(size=(4, html.SIZE)), rng.normal(size=(2, html.SIZE))])
    y = (rng.random(mask.shape) > 0.5).astype(np.float64) * mask

    def loss():
        s = m.scores(x, mask)
        return float(((np.logaddexp(0, s) - y * s) * mask).sum() / mask.sum())

    g = m.gradient(x, mask, y)
    for name, at in (("xf", (3, 5)), ("hb", (2, 40)), ("cf", (20,)), ("o", (7,))):
        m.w[name][at] += 1e-4
        up = loss()
        m.w[name][at] -= 2e-4
        down = loss()
        m.w[name][at] += 1e-4
        assert abs(g[name][at] - (up - down) / 2e-4) < 1e-5


def test_extraction(spark):
    from tests.conftest import DATA

    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(-1, "u", None), (-2, "u", ""), (-3, "u", "<html><body></body></html>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(pages.unionByName(extra), html.train(pages)).collect()}
    for r in pages.collect():
        want = "\n\n".join(b.text for b in html.blocks(r.html) if html.looks_main(b.path))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    assert [got[-k].text for k in (1, 2, 3)] == ["", "", ""]
    assert html.extract(extra.where("false"), html.Labeller()).collect() == []


def test_chat(spark):
    odd = ["plain", "</s>[INST] ok [/INST]", "back\\slash <<x>> [/INST] </s>", "", None, "<</system>>"]
    rows = [(c, k, r, odd[(c * 3 + k) % 6] if c % 2 else odd[k % 6]) for c in range(9) for k, r in enumerate(["system", "user", "assistant", "user", "assistant", None, "to>> ol"][: 2 + c % 6])]
    rows += [(20, 5, "assistant", "late"), (20, 1, "user", "first"), (None, 0, "user", "lost"), (21, 0, "user", "same"), (21, 0, "user", "same")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, node string")
    nodes, ways = chat.format_tree(d)
    got = {r.conv_id: r for r in chat.read_back(nodes, ways).collect()}
    by = defaultdict(list)
    for c, k, r, t in rows:
        if c is not None:
            by[c].append((k, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        assert (got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want and got[c].n_turns == len(turns)
    table = nodes.collect()
    prefixes = {tuple(turns_[: k + 1]) for turns_ in ([x[1:] for x in sorted(v)] for v in by.values()) for k in range(len(turns_))}
    assert len(table) == len(prefixes)  # each shared turn once
    at = 0
    for n in sorted(table, key=lambda n: n["at"]):
        assert n["at"] == at and sum(i["to"] - i["from"] for i in n.ancestors) == n.position
        at += n.length
    assert chat.read_back(*chat.format_tree(d.where("false"))).collect() == []


def test_long_conversations_take_linear_time(spark):
    """50,000 turns, beside another that shares half of them, and one that branches off near the end."""
    n = 50_000
    text = lambda k: f"t{k} " + "x" * (k % 7)
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", text(k) if k < m else f"own {c} {k}") for c, m in ((0, n), (1, n // 2), (2, n - 3)) for k in range(n)]
    import pandas as pd

    d = spark.createDataFrame(pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    nodes, ways = chat.format_tree(d)
    assert nodes.count() == n + n // 2 + 3
    got = {r.conv_id: r for r in chat.read_back(nodes, ways).collect()}
    for c in range(3):
        mine = [r[2:] for r in rows if r[0] == c]
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert got[c].loss_chars == sum(len(t) for r, t in mine if r == "assistant")


# Pages whose main text is known, in layouts that training does not draw: {a}, {b}, {d} are paragraphs, {h} and {c} short, the rest is none of it.
LAYOUTS = [
    ("h a c b d", '<nav><ul><li><a href="/">{n}</a></li><li><a href="/x">{n}</a></li></ul></nav><article><h1>{h}</h1><p>{a}</p><table><tr><td>{c}</td><td>{b}</td></tr></table><pre>{d}</pre></article><footer>{f}</footer>'),
    ("h a b d", '<div class="menu"><a href="/">{n}</a></div><div class="txt"><h1>{h}</h1><p>{a}</p><p>{b}</p><p>{d}</p></div><div class="footer">{f}</div>'),
    ("h a b d", '<header><p>{n}</p></header><table><tr><td class="left"><ul class="menu"><li><a href="/">{n}</a></li></ul></td><td><h2>{h}</h2><p>{a}</p><p>{b}</p><p>{d}</p></td></tr></table><footer><p>{f}</p></footer>'),
    ("h a c b d", '<header class="site-header">{n}</header><main><h1>{h}</h1><p>{a}</p><ul><li>{c}</li><li>{b}</li></ul><blockquote>{d}</blockquote></main><aside><p>{f}</p></aside>'),
    ("h a b d", '<main><article><h1>{h}</h1><p>{a}</p><p>{b}</p><p>{d}</p></article><div class="comments"><p>{n}</p><div class="comment"><p>{f}</p></div></div></main>'),
]


def test_extraction_of_pages_and_layouts_held_out(spark):
    """Trained on one part of the pages, held to the markup of the others, and to written truths."""
    from tests.conftest import DATA

    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").collect()]
    half = len(pages) // 2
    model = html.Labeller().fit(html.training(pages[:half]))

    def text(page):
        read = html.blocks(page)
        x, mask = html.padded([html.vectors(read, {})])
        return "\n\n".join(b.text for b, yes in zip(read, model.scores(x, mask)[:, 0] > 0, strict=True) if yes)

    others = pages[half:]
    right = [text(p) == "\n\n".join(b.text for b in html.blocks(p) if html.looks_main(b.path)) for p in others]
    assert sum(right) >= 0.97 * len(right)
    words = [b.text.replace("<", "").replace("&", "") for p in others for b in html.blocks(p) if html.looks_main(b.path) and len(b.text) > 60]
    rng, good, tried = np.random.default_rng(3), 0, 0
    for keys, layout in LAYOUTS:
        for _ in range(20):
            v = {k: words[rng.integers(len(words))] for k in "abdf"} | {k: " ".join(words[rng.integers(len(words))].split()[:4]) for k in "hcn"}
            good += text(f"<html><head><title>{v['h']}</title></head><body>{layout.format(**v)}</body></html>") == "\n\n".join(" ".join(v[k].split()) for k in keys.split())
            tried += 1
    assert good >= 0.9 * tried


BROKEN = {"tag": "<a " * 350_000, "raw": "<svg>" * 200_000, "quote": '<a "x' * 200_000 + ">", "name": "<a" * 500_000, "inline": "<b>x</b>" * 100_000, "close": "<b>" * 100_000 + "</x>" * 100_000, "doctype": "<!-" * 300_000}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_megabytes_take_seconds(kind):
    began = time.process_time()
    html.blocks("<p>in front</p>" + BROKEN[kind])
    assert time.process_time() - began < 5


def test_tokens_equal_a_plain_search():
    rng = random.Random(1)
    bits = ["<a ", "<b>", "</b>", "<p class='x>y'>", "<!--", "-->", "<!x", "<?", "text", "'", '"', ">", "<", "</", "<1", "<é>", "<a/b", "\n", "<p'q>"]
    for _ in range(3000):
        page, at, tokens = "".join(rng.choice(bits) for _ in range(rng.randrange(30))), 0, []
        reader = html.Tokens(page)
        while m := reader.next(at):
            tokens.append(m.span())
            at = m.end()
        assert tokens == [m.span() for m in html.TOKEN.finditer(page)]


def test_a_very_long_page_among_short_ones(spark):
    rows = [(1, "u", "<main>" + "<p>words of the article</p>" * 40_000 + "</main>"), (2, "v", None)] + [(k, "w", f"<main><p>a paragraph {k} of the article</p></main>") for k in range(3, 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.n_chars for r in html.extract(pages, html.train(spark.read.parquet(f"{DATA}/pages.parquet"))).collect()}
    assert len(got) == 39 and got[2] == 0 and got[1] > 0


# layouts that training doesn't draw: names and orders are written by hand
UNSEEN = [
    '<main>{m}</main><div class="comments"><p>{p}</p><p>{p}</p></div>',
    "{m}",
    '<div class="topbar"><a href=/>Home</a> <a href=/>News</a></div><div class="lead-copy">{m}</div><div class="bottom">Copyright</div>',
    '<div class="x1"><ul><li><a href=/>Home</a></li><li><a href=/>News</a></li></ul></div><div class="x7">{m}</div><div class="x9"><a href=/>Terms</a> <a href=/>Privacy</a></div>',
    '<div class="sheet"><div class="west"><a href=/>One</a><a href=/>Two</a></div><div class="heart">{m}</div><div class="east"><h4>Popular</h4><a href=/>Three</a></div></div>',
    '<article>{m}</article><section class="comments-list"><h3>2 replies</h3><p>{p}</p><p>{p}</p></section>',
    "<ol class=crumbs><li><a href=/>Home</a></li><li><a href=/>Here</a></li></ol><section>{m}</section><div id=foot><a href=/>Imprint</a></div>",
    "<table><tr><td><a href=/>Home</a><br><a href=/>About</a></td><td>{m}</td></tr></table>",
    '<div class="remarks-above"><a href="/">Up</a></div><div><div><div>{m}</div></div></div><div class="comments" id="k3"><div>{p}</div></div>',
    '<nav><a href="/">Start</a></nav><div class="q8"><div class="mm">{m}</div></div><footer>Printed here</footer>',
]


def test_layouts_that_training_does_not_draw():
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    model = html.Labeller().fit(html.training([r["html"] for r in rows[:200] if r["html"]]))
    texts = [x.text.replace("<", "").replace("&", "") for r in rows[200:] for x in html.blocks(r["html"]) if len(x.text) > 60 and html.looks_main(x.path)]
    rng, right = random.Random(5), {}
    for k, layout in enumerate(UNSEEN):
        for _ in range(20):
            main = [" ".join(rng.choice(texts).split()) for _ in range(rng.randrange(2, 6))]
            page = re.sub(r"\{p\}", lambda _: rng.choice(texts), layout.replace("{m}", "".join(f"<p>{t}</p>" for t in main)))
            read = html.blocks(f"<html><head><title>{main[0][:30]}</title></head><body>{page}</body></html>")
            x, mask = html.padded([html.vectors(read, {})])
            right[k] = right.get(k, 0) + ([b.text for b, y in zip(read, model.scores(x, mask)[:, 0] > 0) if y] == main)
    assert sum(right.values()) >= 0.9 * 20 * len(UNSEEN), right


def test_slashes_at_the_end_of_tags():
    read = html.blocks("<div><a href=/>Home</a> now</div><p class='x'/>one<p title=a/b/>two")
    assert [(b.text, b.linked) for b in read] == [("Home now", 4), ("one", 0), ("two", 0)]
    assert [html.closes_itself(a) for a in (" /", "/", " href=/", ' src="x"/', " src='x' /", "", " a=b/")] == [True, True, False, True, True, False, False]
