"""Operators on urls, conversations, vectors and pages against plain Python, on awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharedrift.llm import chat, html, topk, urls

# URLs ---------------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?q#f", "https://example.net/en", "http://badexample.net/en/",
    "http://x.example.com/de/1", "http://example.com/deutsch/", "ftp://org/fr/", "http://a.org/fr/?x", "http://net", "http://net/",
    "http://net?/", "http://a..net/x", "x://b.com/a://c.net/", "http://ü.net/ß", "http://www.spam.org/de/", "http://spam.org",
    "http://notspam.org/", "http://spam.org.uk/", "http://example.net/en/",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    return "".join(c.lower() if c < "\x80" else c for c in host), path.split("?")[0].split("#")[0]


@pytest.mark.parametrize("filter_bytes", [1, urls.FILTER_BYTES])  # many shards, one shard
def test_urls(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(urls, "FILTER_BYTES", filter_bytes)
    block, allow = ["net/", "example.com/de/", "net/"], ["example.net/en/", "org/fr/"]
    pages = spark.createDataFrame(
        [(n % 20, u, "h", "r", 1) for n, u in enumerate(URLS)], "page_id long, url string, host string, rule string, h1 int")
    keys = lambda some: spark.createDataFrame([(k,) for k in some], "key string")
    got = urls.judge(pages, keys([*block, "spam.org"]), keys(allow), [1, 4]).collect()
    assert len(got) == len(URLS) and {"h1", "url"} <= set(got[0].asDict())
    for r in got:
        host, path = parts(r.url)
        fits = [k for k in block + allow if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0]))
                and path.startswith(k[k.index("/"):])]
        rule = max(fits, key=len, default=None)
        listed = host == "spam.org" or host.endswith(".spam.org")
        verdict = ("block" if rule in block else "allow") if rule else ("block" if listed else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert urls.judge(pages.limit(0), keys(block), keys(allow), [1, 4]).count() == 0
    assert {r.verdict for r in urls.judge(pages, keys([]), keys([]), []).collect()} == {"allow"}


def test_urls_keep_columns_of_any_name(spark):
    names = ["_keys", "_block", "_allow", "_h1", "_h2", "_row", "key", "listed"]
    pages = spark.createDataFrame([(u, *[f"{c}{n}" for c in names]) for n, u in enumerate(URLS)],
                                  "url string, " + ", ".join(f"`{c}` string" for c in names))
    keys = spark.createDataFrame([("net/",)], "key string")
    got = urls.judge(pages, keys, keys.filter("false"), [1])
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert sorted(map(str, got.select(*pages.columns).collect())) == sorted(map(str, pages.collect()))


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(30000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("key LIKE '%7'").union(spark.createDataFrame([("elsewhere",)], "key string"))
    levels = urls.cascade(listed, universe)
    rows = universe.select("key", *[h.alias(n) for h, n in zip(urls._hashes(F.col("key")), ("h1", "h2"))]).toPandas()
    assert len(levels) > 1
    assert (urls.holds(levels, rows["h1"].to_numpy(), rows["h2"].to_numpy()) == rows["key"].str.endswith("7").to_numpy()).all()


# Chat ---------------------------------------------------------------------------------------------------------------

def test_chat_reads_back(spark):
    rng = random.Random(4)
    bits = ["&", "&amp;", "&lt;", "&lsqb;", "amp;", "lt;", "<", "[", "]", " é", "\n", "x", "\\", "", *chat.CONTROLS]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "<s>[ROLE]", ""]),
             "".join(rng.choices(bits, k=rng.randint(0, 12)))) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, 1, None, None), (50, None, "assistant", None), (None, 0, "assistant", "a"), (None, 0, "assistant", "a")]
    rows += [(60, t, "assistant", f"turn {t} ") for t in range(500)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id int, turn int, role string, text string, formatted string")
    out = chat.format_conversations(table)
    got = {r.conv_id: r for r in out.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        want = sorted(((-1 if t is None else t, role or "", text or "") for k, t, role, text in rows if k == c))
        assert [tuple(t) for t in r.turns] == [w[1:] for w in want]
        assert r.loss == "".join(text for _, role, text in want if role == "assistant")
        assert r.formatted.count(chat.OPEN) == 1 + sum(a[1] != b[1] for a, b in zip(want, want[1:]))
    assert chat.format_conversations(table.limit(0)).count() == 0


# Top-k --------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("groups, block", [(4096, 8192), (7, 64)])
def test_top_k_equals_brute_force(spark, monkeypatch, groups, block):
    monkeypatch.setattr(topk, "QUERY_GROUP", groups)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    vectors = (centres[rng.integers(0, 8, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    vectors[100:130] = vectors[100]  # ties
    rows = [(n, v.tolist(), 1) for n, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")], 1), (1003, [float("inf")], 1), (1004, [], 1),
             (1005, [2.0, -1.0], 1), (20, vectors[20].tolist(), 1), (None, [1.0], 1)]
    table = spark.createDataFrame(rows, "id int, embedding array<float>, score int").select(
        F.col("id").cast("long").alias("id"), topk.integer_vector(F.col("embedding"), 1024).alias("vector"))
    got = topk.top_k(table, table.filter("id % 20 = 0"), 10).collect()
    kept = [(i, np.floor(1024 * np.pad(np.array(v, dtype=np.float64), (0, 16 - len(v)))).astype(int)) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, q in kept:
        if i % 20 == 0:
            scored = sorted((-int(q @ v), j) for j, v in kept if j != i)[:10]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(table.limit(0), table.limit(0), 10).count() == 0


def test_proof_spares_postings():
    rng = np.random.default_rng(2)
    vectors = np.floor(1024 * rng.normal(size=(5000, 32)) / 6).astype(np.int64)
    block = topk.Block(np.arange(5000), vectors)
    added = []
    real = block._add
    block._add = lambda segments, *rest: (added.append((block.end - block.start)[segments].sum()), real(segments, *rest))
    none = np.zeros(0, dtype=np.int64)
    scores, ids = block.search(3, vectors[3], 10, none, none)
    want = sorted((-int(vectors[3] @ v), j) for j, v in enumerate(vectors) if j != 3)[:10]
    assert list(zip((-scores).tolist(), ids.tolist())) == want
    assert sum(added) < 0.75 * vectors.size


# HTML ---------------------------------------------------------------------------------------------------------------

LONG = " ".join(f"word{k}" for k in range(40))
PAGES = {
    "": "",
    "plain text &amp; more": "plain text & more",
    f"<html><body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>{LONG}<br>b<p>x &lt; <b>y</b>z</article><footer>f</footer>":
        f"T\n{LONG} b\nx < yz",
    f"<body><div class='ad'>{LONG}</div><div id=main><p>{LONG}</p><p>short</p><p>{LONG} <a href='#'>link</a></p></div>"
    f"<ul><li><a href=1>one</a><li><a href=2>two</a></ul><div class='reader comments'><p>{LONG}</p></div>":
        f"{LONG}\nshort\n{LONG} link",
    f"<article><header><h1>Head</h1></header><script>var t='</p><p>no';</script><!-- <p>no</p> --><section><p>{LONG}</p></section>"
    f"<section><h2>S</h2><p>{LONG}</p><aside>no</aside><form>no</form></section></article>":
        f"Head\n{LONG}\nS\n{LONG}",
    f"<main><table><tr><td>{LONG}<td>b&nbsp;&nbsp;c</table><ul><li>i<li>j</ul>tail</main><script>x": f"{LONG}\nb c\ni\nj\ntail",
    "<p a='<b>' b=\">\">q</p></p></div>": "q",
    "<div><script>only</script></div>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


def test_pages_of_any_depth_and_length(spark):
    deep = "<div>" * 20000 + LONG
    rows = [(1, None, "u", 3), (2, "", "u", 3), (3, deep, None, 3), (3, deep, None, 3), (4, f"<article>{'<p>' + LONG:s}" * 3000, "u", 3)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string, url string, n_chars int")).collect()
    texts = sorted((r.page_id, r.text, r.n_chars) for r in got)
    whole = "\n".join([LONG] * 3000)
    assert texts == [(1, "", 0), (2, "", 0), (3, LONG, len(LONG)), (3, LONG, len(LONG)), (4, whole, len(whole))]


def test_articles_of_the_test_pages(spark, sf_dir):
    """The pages' articles stand in one element; menus, adverts and footers around it do not get in."""
    import re
    from html import unescape

    for r in html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("raw", F.col("html"))).collect():
        article = re.search(r"<article>(.*?)</article>", r.raw, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1|ul|li)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert hashlib.sha256(r.text.encode()).digest() and r.n_chars == len(r.text)


def test_broken_pages_are_read_in_one_pass():
    for broken in ("<a " + "b" * 10 ** 6, "<p>x</p><a " * 20000, "text <b " * 30000, "</i><b>" * 30000, "<p x='" * 30000):
        html.main_text("<body>" + broken)  # would take hours if tags were tried again and again
    assert html.main_text("<body><p>kept text</p><p>and this<a href='x") == "kept text\nand this"


def test_text_in_sibling_containers_is_kept():
    """Pages without article or main: every container of the branch that is dense enough, and the heading before it."""
    parts = [f"<p>{'word ' * 200}{n}</p>" for n in range(6)]
    halves = "".join(f"<div>{''.join(parts[n:n + 3])}</div>" for n in (0, 3))
    text = [line for n in range(6) for line in [f"{'word ' * 200}{n}"]]
    assert html.main_text(f"<body><div id=wrap>{halves}</div></body>").split("\n") == text
    page = f"<body><div><h1>The title</h1>{halves}<div><a href=x>more</a></div></div></body>"
    assert html.main_text(page).split("\n") == ["The title", *text]


@pytest.mark.parametrize("page", [
    "<div class='content with-sidebar'>{}</div>", "<article class='post no-comments'>{}</article>",
    "<div class='layout has-banner'><article>{}</article></div>", "<div id='search-result-article'>{}</div>",
    "<div data-id=menu data-role='ad'>{}</div>", "<article class=related>{}</article>", "<div class=share>{}</div>",
    "<article><dialog open>{}</dialog></article>"])
def test_names_do_not_drop_the_article(page):
    text = "words of the article " * 30
    assert html.main_text("<body>" + page.format(f"<p>{text}</p>") + "<div class=ad>Buy</div>").strip() == text.strip()


def test_names_and_formulas():
    text = "words of the article " * 30
    for name in ("class='big ad'", "id=cookie-banner", "role=search", "class=comments-list", "class=ad-1"):
        assert html.main_text(f"<article><p>{text}</p><div {name}>noise</div></article>") == text.strip()
    formula = "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>"
    assert html.main_text(f"<article><p>{text}with {formula} here</p></article>") == text + "with x=2 here"


def test_articles_are_found_without_their_tag():
    """Pages whose article elements are renamed to div give the same text, and lose no line of it."""
    import re

    import duckdb

    pages = [h for [h] in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet' ORDER BY page_id").fetchall()]
    pairs = [(html.main_text(h), html.main_text(re.sub(r"(?i)(</?)article\b", r"\1div", h))) for h in pages]
    assert sum(a == b for a, b in pairs) >= 0.99 * len(pages)
    assert not [a for a, b in pairs if Counter(a.split("\n")) - Counter(b.split("\n"))]


def test_a_container_stands_for_its_article_but_not_with_a_menu_in_it():
    prose = "Some words of a long enough paragraph, with a comma and an end. " * 5
    page = f"<body><div id=x><p>{prose}</p><p>Short.</p><div><p>{prose}<b>open</div><p>{prose}</p></div></body>"
    assert html.main_text(page).count("Short.") == 1 and html.main_text(page).count("Some words") == 15
    links = "<ul>" + "".join(f"<li><a href=/{k}>Somewhere else {k}</a>" for k in range(9)) + "</ul>"
    page = f"<body><div>{links}<div><p>{prose}</p><p>{prose}</p><p>{prose}</p></div></div></body>"
    assert "Somewhere" not in html.main_text(page) and html.main_text(page).count("Some words") == 15
