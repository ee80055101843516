"""HTML extraction, hard negatives and ranked search against plain versions."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnforge.llm import catalog, extract, negatives, ranked
from churnforge.llm.pagetree import page_tree, runs
from churnforge.llm.wrappers import align, dump, label_page, load, page_items, slots
from tests.conftest import SF001
from tests.llm import brute


def extra(df):
    """Columns whose names operators use inside."""
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(
        "id host expr stats n chars links low high part group share q row dim block anchor number terms tf n_chars score".split())
        if c not in df.columns])


SITE = ("<html><head><title>{t}</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Home</a>"
        "<li><a>News</a></ul></nav><div class='cookie-notice'>We use cookies</div><main><article><header><h1>{t}</h1>"
        "<span>by me</span></header>{body}<div class='share-buttons'>Share</div><form>Mail <input><button>Go</button></form>"
        "</article><aside>More</aside><section id='comments'><article class='comment'>Nice</article></section></main>"
        "<div id=ad-1>Buy</div><footer>&copy; us</footer><script>if(a<b){{x='</article>'}}</script></body></html>")
SOUP = ("<div id=top>My Site</div><div><div><a href=1>Home</a> <a href=2>About us and more</a></div><div><h2>{t}</h2>{body}</div></div>"
        "<div>All rights kept</div>")


def plain_article(page):
    """The text of the only article of a generated page."""
    inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = re.split(r"<(?:/?p|/?h1|br)[^>]*>", re.sub(r"</?b>", "", inside))
    return " ".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


@pytest.mark.parametrize("broadcast_bytes", [16 << 20, 0])
def test_extraction_of_known_pages(spark, broadcast_bytes):
    bodies = ["<p>One <b>bo</b>ld &lt;word&gt;\n and&nbsp;more<p>two<br>lines", "<p>x &amp;amp; y</p><ul><li>a<li>b</ul>",
              "<table><tr><td>1<td>2<tr><td>3</table>", "<dl><dt>k<dd>v<dt>l<dd>w</dl><p>" + "long " * 40_000, "<h2>s</h2>t<!-- no --><h2>u</h2>v"]
    texts = ["One bold <word> and more two lines", "x &amp; y a b", "1 2 3", "k v l w " + ("long " * 40_000).strip(), "s t u v"]
    rows, want = [], {}
    for k, (body, text) in enumerate(zip(bodies, texts, strict=True)):
        rows += [(k, f"http://a.example.com/{k}", SITE.format(t=f"Title {k}", body=body)),
                 (k + 10, f"http://b.example.com/{k}", SOUP.format(t=f"Title {k}", body=body + f"<p>some plain text that is long enough {k}"))]
        want[k], want[k + 10] = f"Title {k} {text}", f"Title {k} {text} some plain text that is long enough {k}"
    odd = [(20, "no host", None), (21, None, ""), (22, "http://c.example.com", "<p>alone"), (22, "http://c.example.com", "<p>alone"),
           (None, "http://c.example.com/x", "a < b & c"), (23, "http://d.example.com", "<nav>only a menu</nav>"),
           (24, "http://d.example.com", "<p class=\"x>unclosed")]
    want |= {20: "", 21: "", 22: "alone", 23: "", 24: "unclosed", None: "a < b & c"}
    df = spark.createDataFrame(rows + odd, "page_id long, url string, html string")
    config = extract.ExtractConfig(fan_in=2, broadcast_bytes=broadcast_bytes, pages_a_share=2, held=3)
    got = extract.extract_text(extra(df), config=config).collect()
    assert len(got) == len(rows + odd) and sum(r["page_id"] == 22 for r in got) == 2
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["url"] for r in got} == {i: u for i, u, _ in rows + odd}
    assert extract.extract_text(df.limit(0)).collect() == []


def test_extraction_of_the_pages_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    for r in catalog.op11_html_extraction(spark, SF001).collect():
        assert r["text"] == plain_article(pages.pop(r["page_id"]))
    assert not pages


def test_wrappers_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    block = lambda: rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<div class=ad>{}</div>", "<ul><li>{}</ul>", "<div><p>{}</div>"]).format(rng.random())
    rows = [(f"h{k % 3}", f"<body>{''.join(block() for _ in range(rng.randint(0, 9)))}") for k in range(200)]
    df = spark.createDataFrame(rows, "host string, html string")
    config = extract.ExtractConfig(fan_in=4, held=5)
    one, many = (sorted(map(tuple, extract.infer_wrappers(df.repartition(n), config).collect())) for n in (1, 7))
    assert one == many and [h for h, _, _ in one] == ["h0", "h1", "h2"]
    for host, expr, stats in one:                           # the wrapper has a slot for every text of its pages
        for _, page in (r for r in rows if r[0] == host):
            root = page_tree(page)
            label_page(page_items(root), expr, stats)
            assert all(r.tier > 0 for r in runs(root))


def test_alignment_resolves_mismatches():
    shape = lambda *pages: re.sub(r'null|"|\[\]', "", dump(made(pages)))

    def made(pages):
        items = None
        for p in pages:
            x = page_items(page_tree(p))
            items = x if items is None else align(items, x, True)
        return items

    assert shape("<p>a<p>b<p>c") == shape("<p>a<p>b") == "[[p,2,[[T,0,]]]]"                           # repeated
    assert shape("<h1>a</h1><p>b", "<p>c") == "[[h1,1,[[T,0,]]],[p,0,[[T,0,]]]]"                       # optional
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>") == "[[dl,0,[[(dt dd),2,[[dt,0,[[T,0,]]],[dd,0,[[T,0,]]]]]]]]"
    wide = made(["".join(f"<h{k % 6 + 1}>x</h{k % 6 + 1}><p>y</p><div class=ad>z</div>{'<ul></ul>' * (k % 5 == 0)}" for k in range(60))])
    assert wide[0].key == "(*)" and len(wide[0].body) == 9
    again = load(dump(wide), [x.stat for x in slots(wide)])
    assert dump(again) == dump(wide) and [x.stat for x in slots(again)] == [x.stat for x in slots(wide)]


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "x", "<a b=\"'" * 20_000, "<" * 100_000, "<!--" * 50_000, "<span>" * 30_000 + "</b>" * 30_000,
                                  "<script>" * 50_000, "".join(f"<x{k} class=c{k}>t" for k in range(20_000)), "<p>&amp" * 30_000])
def test_hostile_pages_end(page):
    page_items(page_tree(page))


def vectors(seed, n=150, dim=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    rows = [(k, [float(np.float32(x)) for x in centre[k % 4] + rng.normal(size=dim) * 0.4], int(rng.integers(0, 3))) for k in range(n)]
    return rows + [(200, rows[0][1], 1), (200, rows[0][1], 1), (None, rows[1][1], 0), (None, rows[1][1], 2), (300, None, 1),
                   (310, [0.0] * dim, 1), (320, [float("nan")] * dim, 1), (330, [None] * dim, 1), (340, rows[2][1], None),
                   (350, [], 1), (360, [], 2), (370, [], 1), (400, [1.0, -2.0], 1), (410, [1.0, 2.0], 1), (411, [1.0, 1.0], 2), (412, [1.5, 1.5], 2),
                   (420, [1e30] * 3, 0), (430, [1e30, 0.0, 0.0], 0), (431, [5e29, 0.0, 0.0], 1)]


@pytest.mark.parametrize("config", [negatives.NegativeConfig(rows_a_block=16, anchors_a_block=4), negatives.NegativeConfig(),
                                    negatives.NegativeConfig(positives=2, negatives=7, low=20, high=110)])
def test_negatives_against_all_pairs(spark, config):
    rows = [r for r in vectors(3) if not (r[1] and abs(r[1][0] or 0) > 1e20)]
    df = extra(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = negatives.mine_negatives(df.repartition(3), F.col("vec_id") % 10 == 0, config=config).collect()
    want = brute.negatives(rows, lambda i: i is not None and i % 10 == 0, config)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 50


def test_negatives_of_very_large_vectors_and_an_empty_table(spark):
    rows = vectors(4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [r for r in negatives.mine_negatives(df, F.col("vec_id") % 10 == 0).collect() if r["anchor_id"] in (420, 430)]
    assert all(abs(r["positive_score"]) <= 2 ** 63 - 1 for r in got)
    assert negatives.mine_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine_negatives(df, F.col("vec_id") == -1).collect() == []


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (40, 3))
    order, parent, length = negatives.spanning_tree(x)
    place = {int(v): k for k, v in enumerate(order)}
    assert sorted(order.tolist()) == list(range(40)) and all(place[int(p)] < place[k] for k, p in enumerate(parent) if p >= 0)
    edges = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), i, j) for i in range(40) for j in range(i))
    root, total = list(range(40)), 0.0
    for d, i, j in edges:
        if root[i] != root[j]:
            old, total = root[i], total + d
            root = [root[j] if r == old else r for r in root]
    assert abs(length.sum() - total) < 1e-6


def passages(seed, n=120):
    rng = random.Random(seed)
    word = lambda: f"{'abcdefg'[int(rng.random() ** 2 * 7)]}{int(rng.random() ** 3 * 40)}"
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(n)]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 12)))) for k in range(25)]
    docs += [(200, None), (201, ""), (202, " .;[]@ "), (203, docs[1][1]), (203, docs[1][1]), (204, docs[1][1]), (None, docs[1][1]),
             (205, "A1.É é\x00a1_b2-ǅ ǆ"), (206, "a0 " * 60_000 + "zz"), (207, "zz")]
    return docs, items + [(50, None), (51, ""), (52, "É zz a1"), (52, "É zz a1"), (None, "zz A1"), (53, "nowhere"), (54, " ".join(f"a{k}" for k in range(40)))]


@pytest.mark.parametrize("config", [ranked.RankedConfig(), ranked.RankedConfig(k=3, items_a_leaf=2, docs_a_leaf=3, docs_a_batch=17, first_look=2, entries_a_batch=60),
                                    ranked.RankedConfig(terms_a_block=9, docs_a_leaf=1, items_a_leaf=1)])
def test_ranked_search_against_all_pairs(spark, config):
    docs, items = passages(6)
    left = extra(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    right = extra(spark.createDataFrame(items, "item_id long, text string"))
    got = ranked.rank_documents(left, right, config=config).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.ranked(docs, items, config), key=str)


def test_ranked_search_takes_empty_tables(spark):
    docs, items = (spark.createDataFrame(r, s) for r, s in zip(passages(7), ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert ranked.rank_documents(docs.limit(0), items).collect() == []
    assert ranked.rank_documents(docs, items.limit(0)).collect() == []
    assert ranked.rank_documents(docs.where("text is null"), items).collect() == []


def test_bounds_drop_batches():
    """Documents of the wrong kind are never scored."""
    rng = np.random.default_rng(8)
    items = ranked.Items(np.arange(8), [f"t{k}" for k in range(400)], np.repeat(np.arange(8), 10), np.concatenate([k * 50 + np.arange(10) for k in range(8)]))
    search = ranked._Search(items, rng.integers(1_000, 9_000, 400), np.zeros(8, np.int64), ranked.RankedConfig(items_a_leaf=1))
    kind = rng.integers(0, 8, 4_000)
    doc = np.repeat(np.arange(4_000), 20)
    term = np.concatenate([k * 50 + rng.choice(50, 20, replace=False) for k in kind])
    search.batch(np.arange(4_000), doc, term, rng.integers(100_000, 900_000, len(doc)))
    assert 4_000 * 8 / 64 < search.scored < 4_000 * 8 / 4           # each item has terms of one of eight kinds of documents
