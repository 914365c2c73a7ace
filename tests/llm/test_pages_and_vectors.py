"""Main text of pages, nearest neighbours, the pipeline, and the registered queries."""

from __future__ import annotations

import html
import os
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from placetrend.llm.html_text import extract_text, main_text
from placetrend.llm.neighbours import nearest_neighbours
from placetrend.llm.queries import ORACLE, QUERIES
from tests.helpers import plan_of
from tests.llm.fixtures import awkward

SF_DIR = "/root/testdata/sf0.001"


def plain_article(page):
    article = re.search("<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
    return "\n".join(x for x in blocks if x)


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    expected = {(r.page_id, r.url): plain_article(r.html) for r in pages.collect()}
    found = extract_text(pages).collect()
    assert {(r.page_id, r.url): r.text for r in found} == expected and all(r.n_chars == len(r.text) for r in found)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("no tags &amp; all", "no tags & all"),
        ("<p>a&nbsp;b<br>c\n d<p>e", "a b c d\ne"),
        ("<nav>m</nav><article><header><h1>T</h1></header><p>x</p><aside>s</aside><div class='comments'><p>c</p></div></article><footer>f</footer>", "T\nx"),
        ("<div id=sidebar><p>s</p></div><div><p>long text of the page</p><p>b</p></div><form>f</form>", "long text of the page\nb"),
        ("<article><p>t</p><script>var a='</p>';</script><style>p{}</style><noscript>n</noscript></article>", "t"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc d"),
        ("<![CDATA[ x ]]><p>y</p>", "y"),
        ("<div>" * 300 + "deep" + "</div>" * 300, "deep"),
        ("<article><p>" + "w " * 200_000 + "</p></article>", ("w " * 200_000).strip()),
        ("</p></div><p>open <b>bold", "open bold"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


LONG = " ".join(["a long paragraph of the article"] * 30)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class=post><h1>Title</h1><p>lead</p><div class=entry><p>{LONG}</p><p>{LONG}</p></div></div>", f"Title\nlead\n{LONG}\n{LONG}"),
        (f"<div><h2>Title</h2><p>12 May</p><div><p>{LONG}</p><p>{LONG}</p></div></div><div><a>x</a><a>y</a></div>", f"Title\n12 May\n{LONG}\n{LONG}"),
        (f"<div><div class=top><h1>T</h1></div><div><p>{LONG}</p></div></div><div class=sidebar>s</div>", f"T\n{LONG}"),
        (f"<main><article><p>{LONG}</p></article><article><p>B</p></article></main><footer>f</footer>", f"{LONG}\nB"),
        (f"<main><h1>T</h1><p>intro</p><article><p>{LONG}</p></article><aside>s</aside></main>", f"T\nintro\n{LONG}"),
    ],
)
def test_headline_lead_and_all_of_main_stay(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="layout has-sidebar"><article><h1>T</h1><p>{LONG}</p></article><div class="sidebar"><p>{LONG}</p></div></div>', f"T\n{LONG}"),
        (f'<div id="page-with-comments"><main><p>{LONG}</p></main><section id="comments"><p>{LONG}</p><p>{LONG}</p></section></div>', LONG),
        (f'<div class="sidebar-layout"><h1>T</h1><div><p>{LONG}</p></div></div><div class="sidebar"><p>s</p></div>', f"T\n{LONG}"),
        (f'<article><header class="entry-header"><h1>T</h1><p>lead</p></header><p>{LONG}</p></article>', f"T\nlead\n{LONG}"),
        (f'<article><div class="post-header"><p>lead</p></div><p>{LONG}</p></article>', f"lead\n{LONG}"),
        (f'<div class="post"><header class="post-header"><h1>T</h1></header><div><p>{LONG}</p><p>{LONG}</p></div></div>', f"T\n{LONG}\n{LONG}"),
        (f'<header><h1>Site</h1></header><article><p>{LONG}</p></article>', LONG),
        (f'<article><p>{LONG}</p><p class="notice">Mind the gap in the table.</p></article>', f"{LONG}\nMind the gap in the table."),
        (f'<article><section id="widgets"><h2>Widgets</h2><p>{LONG}</p></section><p>b</p></article>', f"Widgets\n{LONG}\nb"),
        (f'<article><p>{LONG}</p><div class="widget"><a href=x>one</a><a href=y>two</a></div></article>', LONG),
        ('<article><p>the <span class="social">social</span> question and <em class="ad">ad</em> hoc</p></article>', "the social question and ad hoc"),
        ("<article><p>one <script>x()</script>two <svg><text>s</text></svg>three<button>b</button> four</p></article>", "one two three four"),
        ("<article><p>one<style>p{}</style></p><p>two</p></article>", "one\ntwo"),
        (f'<form action="x"><div class="content"><h1>T</h1><p>{LONG}</p></div><input name=q></form>', f"T\n{LONG}"),
        (f'<article><p>{LONG}</p><form><p>your name</p><textarea>t</textarea></form></article>', LONG),
        (f'<article><p>{LONG}</p><div class="comments"><h3>2 replies</h3><p>{LONG}</p><p>{LONG}</p></div></article>', LONG),
        (f'<div role="main"><h2>T</h2><p>{LONG}</p></div><div class="cookie-notice"><p>{LONG}</p></div>', f"T\n{LONG}"),
        (f'<div class="notice"><p>We use cookies.</p></div><div><p>{LONG}</p></div>', LONG),
        (f'<article><p hidden>gone</p><p aria-hidden="true">gone</p><p>{LONG}</p></article>', LONG),
    ],
)
def test_words_of_names_drop_no_article(page, text):
    assert main_text(page) == text


def test_awkward_pages(spark):
    rows = [(1, "u", None), (None, None, "<p>a</p>"), (1, "u", None), (2, "v", "")]
    found = extract_text(spark.createDataFrame(rows, "page_id int, url string, html string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "u", "", 0), (None, None, "a", 1), (1, "u", "", 0), (2, "v", "", 0)], key=repr)
    assert extract_text(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0
    clash = spark.createDataFrame([(1, "u", "<p>a</p>", "x", 9)], "page_id int, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in extract_text(clash).collect()] == [(1, "u", "a", 1)]


def test_neighbours_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, points = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = nearest_neighbours(table).collect()
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        near = set(ids[np.lexsort((ids, far))[:10]].tolist())
        own = sorted((r for r in found if r.query_id == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(far[np.flatnonzero(ids == r.vec_id)[0]], rel=1e-12) for r in own)
        hits += len(near & {r.vec_id for r in own})
    assert hits >= 0.9 * len(found)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(0, 300)]
    rows += [(k, [1.0, 1.0, 1.0, 1.0]) for k in range(1000, 1100)]  # ties
    rows += [(400, None), (500, [0.0] * 4), (600, [float("nan")] * 4), (700, [None, 1.0, 1.0, 1.0]), (800, [float("inf")] * 4), (None, [1.0] * 4), (900, [1.0]), (901, [])]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, part string")
    found = nearest_neighbours(df).collect()
    assert {r.query_id for r in found} == {0, 100, 200, 1000}
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 1000] == [(k, 0.0) for k in range(1001, 1011)]
    assert len(found) == 40
    few = nearest_neighbours(df.where("vec_id in (0, 1, 2, 100)")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (0, 3), (100, 1), (100, 2), (100, 3)]
    assert nearest_neighbours(df.limit(0)).count() == 0 and nearest_neighbours(df.where("vec_id = 400")).count() == 0


def test_an_id_with_several_vectors_is_near_by_the_nearest(spark):
    """A third of all rows has one id, which is a query and a candidate; two ids have vectors far apart."""
    rng = np.random.default_rng(1)
    rows = [(7, [50.0, 1.0]), (7, [0.0, 1.0]), (100, [50.0, 1.0]), (200, [0.0, 1.1])]
    rows += [(k, rng.normal(size=2).tolist()) for k in range(300, 400)] + [(500, rng.normal(10, 5, size=2).tolist()) for _ in range(50)]
    found = nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q in (100, 200, 300, 500):
        far = {}
        for a in points[ids == q]:
            for i, d in zip(ids, np.sqrt(((points - a) ** 2).sum(axis=1)), strict=True):
                if i != q:
                    far[int(i)] = min(far.get(int(i), np.inf), d)
        want = sorted((d, i) for i, d in far.items())[:10]
        got = sorted((r["rank"], r.score, r.vec_id) for r in found if r.query_id == q)
        assert [i for _, _, i in got] == [i for _, i in want] and [s for _, s, _ in got] == pytest.approx([d for d, _ in want])
    assert {r.query_id for r in found} == {100, 200, 300, 500}


def test_pipeline_stages_on_awkward_rows(spark):
    """Null and repeated ids, clashing names, no usable label: each stage keeps the columns and loses no good row."""
    df, rows = awkward(spark)
    docs = df.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("lang", F.lit("xx"))
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "read", lambda *a: labels)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.dtypes == docs.dtypes, name
            kept = out.collect()
            held = {(r.doc_id, r.source) for r in docs.collect()}
            assert kept and {(r.doc_id, r.source) for r in kept} <= held, name
            docs = spark.createDataFrame(kept, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF_DIR)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        before, after = {r.doc_id: r for r in seen.collect()}, out.collect()
        ids = [r.doc_id for r in after]
        assert set(ids) <= set(before)
        if name.startswith("quality"):
            base = [i for i, r in before.items() if len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50 and labels.get(i) == 1]
            assert len(set(base) - set(ids)) <= 0.02 * len(base)
        elif name.startswith("simhash"):
            assert len(ids) == len(set(ids))
        elif name.startswith("substring"):
            assert len(ids) == len(before) and all(len(r.text) <= len(before[r.doc_id].text) for r in after)
            assert all(r.n_chars == len(r.text) for r in after if r.text != before[r.doc_id].text)
        seen = spark.createDataFrame(after, out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF_DIR)
    assert last.count() == seen.count() and last.where("not round_trip").count() == 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0, name


def test_registered_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op3_mixing", "op5_licenses"])
def test_native_operators_run_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("lacking", ["public_tokenizers", "xxhash", "placetrend.llm", "corpus_pipeline"])
def test_the_other_queries_need_nothing_of_this_part(lacking):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {lacking!r} or name.startswith({lacking!r} + "."):
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = entry.queries()
assert "composite_score" in names and not any(n.startswith("op1") for n in names) and set(entry.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
