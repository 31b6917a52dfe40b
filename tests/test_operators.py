"""The library's own operators: hand-computed cases, properties, and the registry's SQL."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import stem, urls
from weftline.functions import text as tx
from weftline.operators import bm25, chunking, curation, filters, fusion, generation, html, labels, metrics, vector
from weftline.plans import pipeline as plans
from weftline.sources import tables


def value(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items()))
    return row.select(column.alias("v")).first()["v"]


# ------------------------------------------------------------------ URLs and sitemaps

HOST = "help.example.com"


def test_url_functions(spark):
    u = f"https://{HOST}/hc/en-us/articles/123-guide?x=1#top"
    assert value(spark, urls.normalize_url("u"), u=u) == f"https://{HOST}/hc/en-us/articles/123-guide"
    assert value(spark, urls.normalize_url("u"), u=" http://h/ ") == "http://h"
    cases = {u: True, f"https://{HOST}/hc/fr/articles/1": False, f"https://{HOST}/hc/en-us/categories/1": False, "https://other.com/hc/en-us/articles/1": False, "not a url": False, f"https://{HOST}:8080/hc/en-us/articles/1": False}
    for case, want in cases.items():
        assert value(spark, urls.is_article_url("u", HOST), u=case) is want
    assert value(spark, urls.document_id("u"), u=f"https://{HOST}/hc/en-us/articles/123456789-auto-layout-basics") == "help-center-123456789-auto-layout-basics"


@pytest.mark.parametrize(("title", "crumbs", "want"), [("Guide", ["Design", "Dev Mode"], "dev mode"), ("Other", ["Design", "Work Together in Files"], "work together in files"), ("Fine", ["Design"], None), ("All about dev-mode", [], "dev mode")])
def test_scope(spark, title, crumbs, want):
    b = F.array(*map(F.lit, crumbs)).cast("array<string>")
    assert value(spark, urls.excluded_phrase(F.lit(f"https://{HOST}/a"), F.lit(title), b), x=1) == want


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc> https://h/a.xml </loc></sitemap></sitemapindex>"
    pages = f"<urlset {ns}><url><loc>https://h/1</loc></url><url><loc>https://h/2</loc></url></urlset>"
    assert value(spark, urls.sitemap("x"), x=index).asDict() == {"sitemaps": ["https://h/a.xml"], "pages": [], "error": None}
    assert value(spark, urls.sitemap("x"), x=pages).asDict() == {"sitemaps": [], "pages": ["https://h/1", "https://h/2"], "error": None}
    assert value(spark, urls.sitemap("x"), x="<rss/>").asDict() == {"sitemaps": [], "pages": [], "error": None}


# ------------------------------------------------------------------ text


def test_text_functions(spark):
    assert value(spark, tx.normalize_whitespace("s"), s=" a \t b , c\n!") == "a b, c!"
    assert value(spark, tx.slugify("s"), s="Hello,  World!") == "hello-world"
    assert value(spark, tx.query_key("s"), s="What's  NEW?") == "what s new"
    assert value(spark, tx.shorten("s", 8), s="abcd efghij") == "abcd..."
    assert value(spark, tx.overlap(F.lit(0), F.lit(5), F.lit(5), F.lit(9)), x=1) == 0
    assert value(spark, tx.overlap(F.lit(0), F.lit(9), F.lit(2), F.lit(4)), x=1) == 2
    assert [tuple(s) for s in value(spark, tx.all_spans("t", "n"), t="aaaa", n="aa")] == [(0, 2), (1, 3), (2, 4)]
    assert tuple(value(spark, tx.first_span("t", "n"), t="é😀ab", n="ab")) == (2, 4)
    assert value(spark, tx.first_span("t", "n"), t="abc", n="x") is None
    assert value(spark, tx.strip_front_matter("t"), t="---\na: 1\n---\n\nbody") == "body"
    assert value(spark, tx.embedding_text(F.lit("T"), F.array(F.lit("a"), F.lit("b")), F.lit(" x ")), x=1) == "Title: T\nSection: a > b\n\nx"
    assert value(spark, tx.plain_heading("s"), s="**A** [b](http://c) `d`") == "A b d"
    assert value(spark, tx.low_value("s"), s=" Submit ") and not value(spark, tx.low_value("s"), s="content")


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("knightly", "knight"), ("happy", "happi"), ("say", "say"), ("consolidation", "consolid"), ("rate", "rate"), ("controll", "control"), ("skies", "sky"), ("sky", "sky")])
def test_stems(word, want):
    assert stem.stem(word) == want


# ------------------------------------------------------------------ filters


def test_filter_texts():
    assert filters.parse("a>b=c") == filters.Filter("a>b", "$eq", "c")
    assert filters.parse(" n >= 3 ") == filters.Filter("n", "$gte", 3)
    assert filters.parse("x=True").value is True and filters.parse("x!=2.5").value == 2.5
    for bad in ("nothing", "n<abc", "=3", "x="):
        with pytest.raises(ValueError):
            filters.parse(bad)
    assert filters.payload([filters.parse("a=1"), filters.parse("b=2")]) == {"$and": [{"a": {"$eq": 1}}, {"b": {"$eq": 2}}]}


def test_filter_null_rules(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 5), (3, "7", 7)], "id int, s string, n int")
    kept = lambda where: sorted(r["id"] for r in filters.apply(df, where=where).collect())
    assert kept({"s": "x"}) == [1] and kept({"s": {"$ne": "x"}}) == [2, 3] and kept({"n": {"$in": [5, 7]}}) == [2, 3]
    assert kept({"n": {"$ne": 5}}) == [1, 3] and kept({"s": {"$gt": 6}}) == [3] and kept({"n": {"$lt": 6, "$gt": 4}}) == [2]
    assert kept({"gone": {"$ne": 1}}) == [1, 2, 3] and kept({"gone": 1}) == [] and kept({"n": "7"}) == [] and kept(None) == [1, 2, 3]
    with pytest.raises(ValueError):
        kept({"n": {"$like": 1}})


# ------------------------------------------------------------------ retrieval and fusion


def results(spark, *rows):
    return spark.createDataFrame(rows, "query_id int, id string, rank int, distance double")


def test_rrf_by_hand(spark):
    a = results(spark, (1, "x", 1, 0.1), (1, "y", 2, 0.2))
    b = results(spark, (1, "y", 1, 3.0), (1, "z", 2, 4.0))
    got = {r["id"]: r for r in fusion.weighted_rrf({"a": a, "b": b}, weights={"a": 0.7, "b": 0.3}).collect()}
    assert math.isclose(got["y"]["distance"], -(0.7 / 62 + 0.3 / 61), abs_tol=1e-11) and got["y"]["rank"] == 1
    assert got["y"]["component_ranks"] == {"a": 2, "b": 1} and got["y"]["best_component"] == "a"
    even = {r["id"]: r["rank"] for r in fusion.weighted_rrf({"a": results(spark, (1, "q", 1, 0.0)), "b": results(spark, (1, "p", 1, 0.0))}, 1).collect()}
    assert even == {"p": 1}
    for bad in ({"a": 1.0}, {"a": 0.5, "b": 0.6}, {"a": 1.5, "b": -0.5}):
        with pytest.raises(ValueError):
            fusion.normalize_weights(["a", "b"], bad)


def test_union_keeps_first_seen_and_all(spark):
    a, b = results(spark, (1, "x", 1, 0.1), (1, "y", 2, 0.2)), results(spark, (1, "w", 1, 0.0), (1, "x", 2, 0.5))
    assert [(r["id"], r["rank"], r["distance"]) for r in fusion.union({"a": a, "b": b}).orderBy("rank").collect()] == [("x", 1, 1.0), ("y", 2, 2.0), ("w", 3, 3.0)]


def test_rrf_does_not_depend_on_order_of_components(spark):
    a, b = results(spark, *((1, f"d{k}", k, float(k)) for k in range(1, 9))), results(spark, *((1, f"d{9 - k}", k, float(k)) for k in range(1, 9)))
    order = lambda x: [(r["id"], r["distance"]) for r in fusion.weighted_rrf(x).orderBy("rank").collect()]
    assert order({"a": a, "b": b}) == order({"b": b, "a": a})


def test_pipeline_reranks_candidates(spark):
    docs = spark.createDataFrame([("a", "red apple pie"), ("b", "red apple"), ("c", "green pear"), ("d", None)], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "red apple"), (2, "pear")], "query_id int, query string")
    pipe = plans.Pipeline([plans.KeywordComponent(docs)], scorer=lambda q, t: fusion.jaccard(tx.terms(q), tx.terms(t)), texts=docs.withColumnRenamed("chunk_id", "id"))
    got = [(r["query_id"], r["rank"], r["id"], r["distance"]) for r in pipe.retrieve(plans.Request(queries, 1)).orderBy("query_id").collect()]
    assert got == [(1, 1, "b", -1.0), (2, 1, "c", -0.5)]
    with pytest.raises(ValueError):
        plans.Pipeline([plans.KeywordComponent(docs)], "union", {"bm25": 1.0})
    with pytest.raises(ValueError):
        plans.Request(queries, 0)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two two"), (2, "two three"), (3, "")], "id int, text string")
    bm25.build(docs, "id", "text").save(str(tmp_path))
    index = bm25.Index.load(spark, str(tmp_path))
    queries = spark.createDataFrame([(1, "two")], "q int, text string")
    fresh = bm25.top_k(docs, queries, 5, "id", "text", "q", "text").collect()
    assert [r["id"] for r in fresh] and fresh == bm25.top_k(docs, queries, 5, "id", "text", "q", "text", index=index).collect()
    n, avg, df, tf, dl = 3, 5 / 3, 2, 2, 3
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert math.isclose(-next(r["distance"] for r in fresh if r["id"] == 1), want, abs_tol=1e-6)


def test_vector_blocks_equal_one_block(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    ask = df.where("id < 20").select(F.col("id").alias("q"), F.col("v").alias("w"))
    whole = sorted(vector.top_k(df, ask, 3, "id", "v", "q", "w").collect())
    monkeypatch.setattr(vector, "BLOCK", 7)
    assert sorted(vector.top_k(df, ask, 3, "id", "v", "q", "w").collect()) == whole and all(r["id"] == r["query_id"] for r in whole if r["rank"] == 1)
    near = vector.lsh_top_k(df, ask, 3, "id", "v", "q", "w", bits=3, tables=16).collect()
    assert len({tuple(r) for r in near} & {tuple(r) for r in whole}) >= 0.9 * len(whole)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_lsh_finds_nine_tenths_of_the_neighbours(spark, sf):
    from weftline.plans import registry

    found, exact = ({(r["query_id"], r["id"]) for r in registry.QUERIES[q](spark, f"/root/testdata/{sf}").collect()} for q in ("lsh_topk", "vector_topk_cosine"))
    assert len(found & exact) >= 0.9 * len(exact)


# ------------------------------------------------------------------ metrics


@pytest.mark.parametrize("n_rel", [1, 2, 5])
def test_metrics_by_hand(spark, n_rel):
    flags = [0, 1, 0, 1] if n_rel > 1 else [0, 1, 0, 0]
    rel = [f"r{k}" for k in range(n_rel)]
    ids, left = [], list(rel)
    for k, f in enumerate(flags):
        ids.append(left.pop(0) if f else f"n{k}")
    found = results(spark, *((1, i, k + 1, float(k)) for k, i in enumerate(ids)))
    qrels = spark.createDataFrame([(1, r) for r in rel] + [(2, "x")], "query_id int, id string")
    got = {(r["query_id"], r["k"]): r for r in metrics.per_query(found, qrels, [10, 1, 3, 3]).collect()}
    assert len(got) == 6 and got[2, 3]["ndcg_at_k"] == 0 and got[2, 1]["hit"] is False and got[2, 10]["first_relevant_rank"] is None
    for k in (1, 3, 10):
        seen, ap, gain = 0, 0.0, 0.0
        for rank, f in enumerate(flags[:k], 1):
            if f:
                seen += 1
                ap += seen / rank
                gain += 1 / math.log2(rank + 1)
        r, most = got[1, k], min(n_rel, k)
        want = (seen / k, seen / n_rel, ap / most, gain / sum(1 / math.log2(j + 1) for j in range(1, most + 1)))
        assert all(map(math.isclose, (r["precision_at_k"], r["recall_at_k"], r["average_precision_at_k"], r["ndcg_at_k"]), want))
    total = {r["k"]: r for r in metrics.summary(metrics.per_query(found, qrels, [10])).collect()}
    assert total[10]["n_queries"] == 2 and total[10]["mrr_at_k"] == 0.25
    with pytest.raises(ValueError):
        metrics.cutoffs([0])


def test_ties_in_separate_stretches_stay_apart(spark):
    found = results(spark, (1, "c", 1, 0.5), (1, "a", 2, 0.5), (1, "x", 3, 0.7), (1, "b", 4, 0.5))
    assert [r["id"] for r in metrics.stabilize_ties(found).orderBy("rank").collect()] == ["a", "c", "x", "b"]


def test_run_labels_and_common_metrics(spark):
    named = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos int, label string")
    assert [r["unique_label"] for r in metrics.unique_labels(named).orderBy("pos").collect()] == ["a #1", "b", "a #2"]
    runs = spark.createDataFrame([("x", 1, "m", 0.1), ("y", 1, "m", 0.2), ("y", 1, "n", 0.2)], "label string, k int, metric string, value double")
    assert [r["metric"] for r in metrics.common_metrics(runs).collect()] == ["m"]


# ------------------------------------------------------------------ spans and labels


def test_spans_and_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa b"), (2, "é😀ab"), (3, None)], "id long, text string")
    needles = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "")], "n long, s string")
    got = sorted(map(tuple, labels.find_spans(docs, needles, "id", "text", "n", "s").collect()))
    assert got == [(1, 1, 0, 2), (1, 1, 1, 3), (1, 1, 2, 4), (2, 2, 2, 4), (3, 1, 0, 2), (3, 1, 1, 3), (3, 1, 2, 4)]
    assert len(labels.find_spans(docs, needles, "id", "text", "n", "s", first=True).collect()) == 3
    one = labels.disambiguate(labels.find_spans(docs, needles, "id", "text", "n", "s"), docs, suffix=" b")
    assert sorted(map(tuple, one.select("needle_id", "start").collect())) == [(1, 2), (3, 2)]
    targets = spark.createDataFrame([(1, 0, "d", 0, 10), (1, 1, "d", 20, 30), (1, 2, "gone", 0, 5)], "query_id int, target_idx int, document_id string, start long, end long")
    parts = spark.createDataFrame([("d::0", "d", 0, 0, 20), ("d::1", "d", 1, 5, 25), ("d::2", "d", 2, 30, 40)], "chunk_id string, document_id string, chunk_index int, start long, end long")
    got = {r["chunk_id"]: (r["overlap_chars"], r["overlap_score"], r["answer_chars"]) for r in labels.map_to_chunks(targets, parts).collect()}
    assert got == {"d::0": (10, 0.4, 25), "d::1": (10, 0.4, 25)}


# ------------------------------------------------------------------ chunks

MARKDOWN = "---\ntitle: x\n---\n\n# Title\n\nIntro text here.\n\n## Part *one*\n\n- item a\n- item b\n\n```py\n# no heading\n\nx = 1\n```\n\n### Deep\n\nwords words. More words! And more?\n\n## Part two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n"


def test_outline_paths_and_spans():
    plan = chunking.outline(MARKDOWN, "Title")
    assert [s.path for s in plan.sections[1:]] == [(), ("Part one",), ("Part one", "Deep"), ("Part two",)]
    assert all(MARKDOWN[u.start : u.end] == u.text for u in plan.units) and any(u.text.startswith("```py") and "x = 1" in u.text for u in plan.units)
    with pytest.raises(ValueError):
        chunking.outline("---\nno end", "t")


def test_whole_document_is_one_chunk_if_it_fits():
    got = chunking.HierarchicalChunker(max_tokens=500, overlap_tokens=10).chunk(MARKDOWN, "Title")
    assert len(got) == 1 and got[0][0] == () and got[0][1].text.startswith("# Title")


def test_table_rows_repeat_the_header():
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {k} | {k} |" for k in range(40))
    got = chunking.HierarchicalChunker(max_tokens=60, overlap_tokens=0).chunk(table, "T")
    assert len(got) > 3 and all(u.text.startswith("| a | b |") for _, u in got)


words = st.text(alphabet="ab .!?\n#-`|é", max_size=400)


@settings(max_examples=60, deadline=None)
@given(words, st.integers(20, 60), st.integers(0, 15))
def test_chunks_fit_and_lie_inside(text, limit, overlap):
    chunker = chunking.HierarchicalChunker(max_tokens=limit, overlap_tokens=overlap)
    try:
        got = chunker.chunk(text, "T")
    except ValueError:
        return
    for path, u in got:
        assert chunker.tokenizer.count(chunking.prefixed("T", path, u.text)) <= limit and 0 <= u.start <= u.end <= len(text)
    assert {c for _, u in got for c in u.text} >= {c for c in text if c in "abé"}


def test_chunk_table_and_failures(spark):
    docs = spark.createDataFrame([("a", "Title", MARKDOWN), ("b", "T", ""), ("c", "T", None), ("d", "T", "---\nx")], "document_id string, title string, markdown string")
    good, bad = chunking.chunk_markdown(docs, max_tokens=30, overlap_tokens=5)
    assert sorted(r["document_id"] for r in bad.collect()) == ["b", "c", "d"]
    rows = good.orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == [f"a::{k:04d}" for k in range(len(rows))] and len(rows) > 3


def test_windows_and_percentiles(spark):
    docs = spark.createDataFrame([(1, "x" * 2000), (2, "short"), (3, ""), (4, None)], "id int, t string")
    got = sorted((r["chunk_id"], r["start"], r["end"]) for r in chunking.fixed_windows(docs, "id", "t").collect())
    assert got == [("1::0000", 0, 1000), ("1::0001", 900, 1900), ("1::0002", 1800, 2000), ("2::0000", 0, 5), ("3::0000", 0, 0)]
    values = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 10)], "token_count int")
    assert tuple(chunking.token_stats(values).first()) == (5, 1, 3.0, 4, 4, 10) and tuple(chunking.token_stats(values.limit(0)).first()) == (0, 0, 0.0, 0, 0, 0)
    assert chunking.distribution(values, "token_count").first()["p90"] == 7.6
    assert [(r["n"], r["cumulative"]) for r in chunking.histogram(values, "token_count", 2, 0, 10).orderBy("bin").collect()] == [(4, 4), (1, 5)]


# ------------------------------------------------------------------ HTML

PAGE = """<html><head><title>T</title><meta property="og:title" content="Real title"><script type="application/ld+json">{"@graph": [{"@type": "BreadcrumbList", "itemListElement": [{"name": "A"}, {"name": "B"}]}]}</script></head>
<body><nav class="sub-nav"><ol class="breadcrumbs"><li>Home</li><li>Topic</li></ol></nav><main><article><div class="article-body">dropped text<h2>First <b>part</b></h2><p>Hello <a href="/x">link</a> , <em>you</em><br>next <code>a`b</code></p>
<nav>menu items</nav><ul><li>one<ol><li>deep</li></ol></li><li><p>two</p></li></ul><pre><code class="language-py">x = 1\n</code></pre><blockquote><p>quoted</p><p>twice</p></blockquote>
<table><tr><td>a|b</td></tr><tr><td>c</td><td>d</td></tr></table><p>no</p><h1>Top</h1><p>Under the top <a href="#here">anchor</a> <img alt="A chart" src="i.png"></p></div></article></main></body></html>"""


def test_page_to_markdown(spark):
    pages = spark.createDataFrame([(1, "https://h/a/b", PAGE), (2, "u", "<p>no main</p>"), (3, "u", None)], "page_id long, url string, html string")
    good, bad = html.html_blocks(pages)
    assert sorted(r["page_id"] for r in bad.collect()) == ["2", "3"]
    rows = good.orderBy("pos").collect()
    assert [r["block_type"] for r in rows] == ["heading", "p", "list", "pre", "blockquote", "table", "heading", "p"]
    assert [r["heading_path"] for r in rows][-2:] == [["Top"], ["Top"]] and rows[1]["heading_path"] == ["First part"]
    assert rows[0]["markdown"] == "## First **part**" and rows[1]["markdown"] == "Hello [link](https://h/x), *you*\nnext ``a`b``"
    assert rows[2]["markdown"] == "- one\n  1. deep\n- two" and rows[3]["markdown"] == "```py\nx = 1\n```" and rows[4]["markdown"] == "> quoted\n>\n> twice"
    assert rows[5]["markdown"] == "| Column 1 | Column 2 |\n| --- | --- |\n| a\\|b |  |\n| c | d |" and rows[7]["markdown"] == "Under the top anchor![A chart](https://h/a/i.png)"
    body = html.markdown(good).first()["markdown"]
    assert body.startswith("## First **part**\n\nHello") and body.endswith("i.png)\n")
    assert html.links(good).first()["target"] == "https://h/x"
    meta = html.metadata(pages.where("page_id = 1")).first()
    assert (meta["title"], meta["breadcrumbs"], meta["topics"]) == ("Real title", ["A", "B"], ["Home", "Topic"])


# ------------------------------------------------------------------ generation and curation


def test_generation_stages_and_summary(spark):
    class Echo:
        def generate(self, messages):
            if "broken" in messages[-1]["content"]:
                raise RuntimeError("down")
            return "an answer"

    class Judge:
        def generate(self, messages):
            if "odd" in messages[-1]["content"]:
                return json.dumps({"groundedness": 1})
            return generation.judgement(dict(zip(generation.CRITERIA, (5, 4, 3), strict=True)))

    queries = spark.createDataFrame([(1, "fine", None), (2, "broken", None), (3, "odd", None), (4, "lost", "no index")], "query_id int, query string, retrieval_error string")
    found = spark.createDataFrame([(1, 1, "T", "S", "U", "some  text"), (1, 2, "T2", "S", "U", "y" * 2000)], "query_id int, rank int, title string, section string, source_url string, text string")
    prompt = {r["query_id"]: r["user_prompt"] for r in generation.prompts(queries, found).collect()}
    assert "[1] Title: T\nSection: S\nSource: U\nText: some text\n\n[2] Title: T2" in prompt[1] and prompt[1].endswith("y" * 1597 + "...") and prompt[2].endswith("Excerpts:\nNo chunks retrieved.")
    assert [r["rank"] for r in generation.truncated_chunks(found).collect()] == [2]
    rows = generation.evaluate(queries, found, Echo, Judge)
    got = {r["query_id"]: r for r in rows.collect()}
    assert got[1]["judge_evaluation"]["groundedness"]["score"] == 4 and got[2]["generation_error"] == "down" and got[2]["judge_evaluation"] is None
    assert got[3]["judge_error"] and got[3]["generated_answer"] == "an answer" and got[4]["generated_answer"] is None
    total = generation.summary(rows).first()
    assert (total["n_successful"], total["n_failed"], total["avg_context_relevance"], total["generation_error"], total["judge_error"], total["retrieval_error"]) == (1, 3, 5.0, 1, 1, 1)
    assert generation.latency_summary(spark.createDataFrame([], "v double"), "v").first()["total"] == 0.0


def test_curation(spark):
    notes = spark.createDataFrame([("q", 0, "u1", "bc"), ("q", 1, "u2", "x"), ("q", 2, "u1", "zz")], "query string, target_idx int, relevant_url string, relevant_span string")
    manifest = spark.createDataFrame([("u1", "d1", 0), ("u1", "d9", 1)], "source_url string, document_id string, pos int")
    texts = spark.createDataFrame([("d1", "abcbc")], "document_id string, text string")
    got = {r["target_idx"]: (r["document_id"], r["start"], r["end"], r["error"]) for r in curation.complete(notes, manifest, texts).collect()}
    assert got == {0: ("d1", 1, 3, None), 1: (None, None, None, "unknown page"), 2: ("d1", None, None, "span not found")}
    ids = curation.sequential_ids(spark.range(20).withColumn("o", -F.col("id")), "o", 5).orderBy("o").collect()
    assert [r["query_id"] for r in ids] == [f"{k:05d}" for k in range(6, 26)]
    entry = lambda **x: json.dumps({"query": "q", "targets": [{"document_path": "p", "char_span": [0, 4]}], "expected_answer_points": ["a"]} | x)
    raw = spark.createDataFrame([(entry(),), (entry(extra=1),), (entry(query=" "),), (entry(targets=[]),), (entry(expected_answer_points=[""]),), (entry(targets=[{"document_path": "p", "char_span": [4, 4]}]),)], "value string")
    assert [r["error"] for r in curation.validate_entries(raw).collect()] == [None, "wrong keys", "empty query", "no targets", "blank answer point", "bad target"]


# ------------------------------------------------------------------ tables, configuration, streaming


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3)], "k string, v int")
    assert sorted(map(tuple, tables.upsert(old, new, "k").collect())) == [("a", 1), ("b", 3)]
    assert [r["k"] for r in tables.new_only(old, new, "k").collect()] == ["a"] and tables.new_only(old, new, "k", True).count() == 2
    assert [r["missing"] for r in tables.violations(spark.createDataFrame([("", 1), ("x", None)], "a string, b int"), ["a", "b"]).collect()] == [["a"], ["b"]]
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "rows.jsonl"), "a int").count() == 2
    tables.write_summary(spark.createDataFrame([(1, 0.5)], "k int, m double"), str(tmp_path / "m.json"))
    assert tuple(tables.read_runs(spark, [str(tmp_path / "m.json")]).first()) == ("m.json", 1, "m", 0.5)


def test_config():
    section = {"top_k": 5, "candidate_k": 30, "components": ["bm25"], "aggregation_strategy": "weighted_rrf", "metadata_filters": ["n>3"], "topic_filter": {"enabled": False, "where": {"t": 1}}, "component_weights": {"bm25": 1}}
    config = plans.parse_config(section)
    assert config.topic_filter is None and config.request(None).payload == {"n": {"$gt": 3}}
    assert plans.override(config, components=("a", "b")).component_weights is None and plans.override(config, top_k=9).component_weights == {"bm25": 1.0}
    for bad in ({"top_k": 0}, {"components": []}, {"metadata_filters": "x"}):
        with pytest.raises(ValueError):
            plans.parse_config(section | bad)


def test_stream_upserts_new_pages(spark, tmp_path):
    from weftline.sources.versioned import VersionedTable
    from weftline.streaming.ingest import ingest

    page = "<main><p>{} text of it</p></main>"
    for step, rows in enumerate([[(1, "u", page.format("old")), (2, "u", page.format("other"))], [(1, "u", page.format("new"))]]):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
        query = ingest(spark, f"{tmp_path}/pages", f"{tmp_path}/docs", f"{tmp_path}/check")
        query.awaitTermination(120)
    got = {r["page_id"]: r["markdown"] for r in VersionedTable(spark, f"{tmp_path}/docs", "page_id").read().collect()}
    assert got == {"1": "new text of it\n", "2": "other text of it\n"}


# ------------------------------------------------------------------ registry


def test_entry_module_and_a_few_oracles(spark):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and entry.entry(spark).columns
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("bm25_topk", "vector_topk_cosine", "hybrid_union", "label_overlap", "eval_per_query_at_k", "url_scope_filter", "chunk_histogram"):
        made = queries[name](spark, sf)
        cur = con.execute(sql[name])
        at = [c[0] for c in cur.description]
        want = sorted(repr([row[at.index(c)] for c in sorted(at)]) for row in cur.fetchall())
        assert sorted(made.columns) == sorted(at) and sorted(repr([r[c] for c in sorted(at)]) for r in made.collect()) == want, name
