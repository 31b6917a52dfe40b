"""Cases that once gave wrong results or ended a job, and the artifacts' life cycle."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import bm25, chunking, curation, fusion, html, labels, metrics, vector
from weftline.plans import pipeline as plans
from weftline.sources import artifacts, crawl, tables


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_sequential_ids_go_beyond_five_digits(spark, shared):
    got = curation.sequential_ids(spark.range(120_000).repartition(7), "id")
    assert got.agg(F.countDistinct("query_id")).first()[0] == 120_000
    picked = {r["id"]: r["query_id"] for r in got.where("id IN (0, 99998, 99999, 119999)").collect()}
    assert picked == {0: "00001", 99998: "99999", 99999: "100000", 119999: "120000"}
    assert curation.sequential_ids(spark.range(0), "id").count() == 0


def test_text_ids_in_vector_search_and_ties_go_to_the_smaller(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{k:03d}", (rng.normal(size=4) if k % 3 else np.ones(4)).tolist()) for k in range(700)]
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(3)
    got = vector.top_k(chunks, chunks.where("chunk_id IN ('c000', 'c001')").select(F.col("chunk_id").alias("query_id"), "vector"), 5, "chunk_id", "vector", "query_id", "vector").orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got if r["query_id"] == "c000"] == [f"c{k:03d}" for k in (0, 3, 6, 9, 12)]
    mine = np.array(rows[1][1])
    want = sorted((round(1 - float(mine @ np.array(v)), 6), i) for i, v in rows)[:5]
    assert [(r["distance"], r["id"]) for r in got if r["query_id"] == "c001"] == want
    component = plans.VectorComponent(chunks)
    assert component.retrieve(plans.Request(chunks.limit(1).select(F.col("chunk_id").alias("query_id"), F.lit("q").alias("query"), "vector"), 3)).count() == 3


def test_text_ids_in_span_search(spark):
    docs = spark.createDataFrame([("d1", "a needle in hay"), ("d2", None)], "document_id string, text string")
    needles = spark.createDataFrame([("n1", "needle"), ("n2", "")], "needle string, text string")
    assert [tuple(r) for r in labels.find_spans(docs, needles, "document_id", "text", "needle", "text").collect()] == [("n1", "d1", 2, 8)]


def test_blank_chunks_and_empty_chunk_tables_are_refused(spark):
    row = ("c", "d", 0, "s", "t", [], "x", [0, 1], "x", 1, "u", "", "", "", "")
    frame = lambda *rows: spark.createDataFrame(list(rows), tables.CHUNKS)
    assert tables.checked(frame(row), "chunks").count() == 1
    for bad in (("", *row[1:]), (" \t", *row[1:]), (*row[:8], "  ", *row[9:])):
        with pytest.raises(ValueError, match="missing"):
            tables.checked(frame(row, bad), "chunks")
    with pytest.raises(ValueError, match="none"):
        tables.checked(frame(), "chunks")


def test_bad_and_deep_pages_are_rows(spark):
    deep = "<main>" + "<div>" * 3000 + "<p>words at the bottom</p>" + "</div>" * 3000 + "</main>"
    pages = spark.createDataFrame([("bad", "u", "<main><![foo bar]><p>text here</p></main>"), ("deep", "u", deep), ("good", "u", "<main><p>fine text</p></main>"), ("none", None, None)], "page_id string, url string, html string")
    good, failed = html.html_blocks(pages)
    assert {r["page_id"]: r["markdown"] for r in good.collect()} == {"deep": "words at the bottom", "good": "fine text"}
    assert {r["page_id"] for r in failed.collect()} == {"bad", "none"}
    found = {r["page_id"]: r for r in html.metadata(pages).collect()}
    assert found["bad"]["error"] and found["good"]["error"] is None and found["none"]["title"] == "untitled"


def test_rendering(spark):
    """Goldens computed by hand."""
    cases = {
        "<h2>A <b>b</b></h2>": "## A **b**",
        "<p>x <a href='/y'>link <i>it</i></a> , <code>a`b</code><br> z <s>no</s> <a href='#t'>top</a></p>": "x [link *it*](http://h/y), ``a`b``\nz ~~no~~ top",
        "<ul><li>one<ul><li><p>two</p></li></ul></li><li></li><li>three .</li></ul>": "- one\n  - two\n- three.",
        "<ol><li>first</li><li></li><li>third</li></ol>": "1. first\n3. third",
        "<blockquote><p>said one</p><p>said two</p></blockquote>": "> said one\n>\n> said two",
        "<pre><code class='x language-py'>\na = 1\n  b\n</code></pre>": "```py\na = 1\n  b\n```",
        "<table><tr><th>a|b</th></tr><tr><td>c<br>d</td><td>e</td></tr></table>": "| a\\|b |  |\n| --- | --- |\n| c<br>d | e |",
        "<table><tr><td>one</td><td>two</td></tr></table>": "| Column 1 | Column 2 |\n| --- | --- |\n| one | two |",
        "<p><img alt='A picture' data-src='p.png'></p>": "![A picture](http://h/p.png)",
        "<img alt='Just words'>": "[Image: Just words]",
    }
    for page, want in cases.items():
        node = html.parse(page).children[0]
        assert html.shapes(node, "http://h/")[id(node)].block == want, page


def test_malformed_sitemaps_are_rows(spark, shared):
    maps = spark.createDataFrame([("top", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>bad</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc> http://h/1 </loc></url></urlset>"), ("bad", "<urlset><url>"), ("x", None)], "url string, xml string")
    assert [r["url"] for r in crawl.discover(maps, "top").collect()] == ["http://h/1"]
    assert {r["url"] for r in crawl.malformed(maps).collect()} == {"bad", "x"}


def test_chunks_are_stretches_of_their_documents():
    body = "# Title\n\n" + " ".join(f"Sentence number {k} goes here. and on it goes." for k in range(40)) + "\n\n## Lists\n\n" + "\n".join(f"- item {k} with words\n  - below {k}" for k in range(40))
    body += "\n\n## Table\n\n| a | b |\n|---|---|\n" + "\n".join(f"| row {k} | more words {k} |" for k in range(60)) + "\n\n## Code\n\n```py\n" + "\n".join(f"line_{k} = call({k})" for k in range(80)) + "\n```\n\n## Long\n\n" + "word " * 400
    chunker = chunking.HierarchicalChunker(max_tokens=60, overlap_tokens=12)
    got = chunker.chunk(body, "Title")
    assert len(got) > 20
    for path, unit in got:
        assert chunker.tokenizer.count(chunking.prefixed("Title", path, unit.text)) <= 60
        plain = unit.text.replace("| a | b |\n|---|---|\n", "").replace("```py\n", "").replace("\n```", "")
        assert "".join(plain.split()) == "".join(body[unit.start : unit.end].replace("```py\n", "").replace("\n```", "").replace("| a | b |\n|---|---|\n", "").split()) or "```" in unit.text or "|---" in unit.text
        if "```" not in unit.text and "|---" not in unit.text:
            assert "".join(unit.text.split()) == "".join(body[unit.start : unit.end].split())
    sentences = [u.text for p, u in got if not p]
    assert all(not t.startswith("and") for t in sentences)  # no cut before a small letter
    assert all(t.startswith("- item") or t.startswith("##") for t in (u.text for p, u in got if p == ("Lists",)))  # nor at indented items
    assert all("|---|---|" in u.text for p, u in got if p == ("Table",) and "row" in u.text)
    covered = {k for _, u in got for k in range(u.start, u.end)}
    head, fences = body.index("| a | b |"), [body.index("```py"), body.rindex("```")]
    framing = {*range(head, head + 20), *range(fences[0], fences[0] + 5), *range(fences[1], fences[1] + 3)}  # shown around pieces, not part of them
    assert all(k in covered or k in framing or c.isspace() for k, c in enumerate(body.rstrip()))


def slow_windows(pieces, fits, small):
    """Windows by trying every piece after another."""
    held, out = [], []
    for k in range(len(pieces)):
        if held and not fits([*held, k]):
            out.append(held)
            tail = []
            for j in reversed(held):
                if not small([j, *tail]):
                    break
                tail = [j, *tail]
            held = tail
            while held and not fits([*held, k]):
                held = held[1:]
        held = [*held, k]
    return [*out, held] if held else out


@pytest.mark.parametrize("seed", range(8))
def test_windows_equal_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    words = [" ".join(["w"] * int(n)) for n in rng.integers(1, 30, 60)]
    text, pieces = "", []
    for w in words:
        pieces.append(chunking.Piece(len(text), len(text) + len(w)))
        text += w + "\n\n"
    limit, overlap = int(rng.integers(35, 90)), int(rng.integers(0, 34))
    chunker = chunking.HierarchicalChunker(max_tokens=limit, overlap_tokens=overlap)
    shown = lambda ks: chunker._shown(text, [pieces[k] for k in ks])
    size = lambda t: chunker.tokenizer.count(t)
    want = slow_windows(pieces, lambda ks: size(shown(ks)) <= limit, lambda ks: overlap > 0 and size(shown(ks)) <= overlap)
    assert [list(range(a, b)) for a, b in chunker._windows(text, pieces, size)] == want


def test_vocabulary_tokenizer_cuts_by_tokens():
    public = pytest.importorskip("public_tokenizers")
    tokenizer = chunking.VocabularyTokenizer(public.path("byte_bpe_50k.json"))
    chunker = chunking.HierarchicalChunker(tokenizer, max_tokens=40, overlap_tokens=5)
    body = "supercalifragilistic" * 60
    got = chunker.chunk(body, "T")
    assert "".join(u.text for _, u in got) == body and all(tokenizer.count(chunking.prefixed("T", p, u.text)) <= 40 for p, u in got)
    assert tokenizer.__getstate__()["own"] is None


def test_pipeline_from_configuration(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"some words number {k} {'apple' if k % 2 else 'pear'}", "t", '["a"]', "u") for k in range(20)], "chunk_id string, text string, title string, heading_path string, source_url string")
    config = plans.parse_config({"top_k": 3, "components": ["bm25", "vector"], "aggregation_strategy": "union", "reranking": {"enabled": False}})
    queries = spark.createDataFrame([(1, "apple number 3")], "query_id int, query string")
    got = plans.build(config, chunks).retrieve(config.request(queries))
    assert "c3" in {r["id"] for r in got.collect()}
    assert {r["section"] for r in fusion.presented(got, chunks).collect()} == {"a"}
    with pytest.raises(ValueError):
        plans.build(plans.parse_config({"top_k": 3, "components": ["other"]}), chunks)


def test_collections_live_and_die(spark, tmp_path):
    own = artifacts.Collections(spark, str(tmp_path / "collections"))
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, text string")
    assert own.names() == [] and own.get_or_create("a", {"model": "m"})["model"] == "m" and own.get_or_create("a", {"model": "n"})["model"] == "m"
    assert own.upsert("a", rows(("x", "1"), ("y", "1"), ("y", "1"))).count() == 2
    assert {tuple(r) for r in own.upsert("a", rows(("y", "2"), ("z", "2"))).collect()} == {("x", "1"), ("y", "2"), ("z", "2")}
    assert own.names() == ["a"] and own.delete("a") and not own.delete("a")
    with pytest.raises(ValueError):
        own.read("a")
    with pytest.raises(ValueError):
        own.get_or_create("../a", {})


def test_index_is_saved_with_its_analyzer(spark, tmp_path):
    docs = spark.createDataFrame([(1, "running dogs"), (2, "the cat sleeps")], "id int, text string")
    from weftline.functions.stem import stemmed

    terms = bm25.analyzer(["the"], stemmed)
    artifacts.save_index(bm25.build(docs, "id", "text", terms), str(tmp_path / "i"), stem=True, stopwords=["the"], source="docs")
    index, analyze, meta = artifacts.load_index(spark, str(tmp_path / "i"))
    got = bm25.top_k(docs, spark.createDataFrame([(7, "the run dog")], "query_id int, query string"), 3, "id", "text", "query_id", "query", analyze=analyze, index=index)
    assert [r["id"] for r in got.collect()] == [1] and meta["source"] == "docs"
    with pytest.raises(ValueError):
        artifacts.load_index(spark, str(tmp_path / "none"))


def test_scans_and_sinks(spark, shared, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nno json\n[1]\n')
    assert {r["line"] for r in artifacts.malformed_lines(spark, str(tmp_path / "a.jsonl")).collect()} == {"no json", "[1]"}
    (tmp_path / "names.txt").write_text("one\n\n two \none\n")
    known = artifacts.read_names(spark, str(tmp_path / "names.txt"))
    assert {r["name"] for r in known.collect()} == {"one", "two"}
    artifacts.append_names(known, spark.createDataFrame([("two",), ("three",), ("three",)], "name string"), str(tmp_path / "more"))
    assert {r["name"] for r in artifacts.read_names(spark, str(tmp_path / "more")).collect()} == {"three"}
    (tmp_path / "d.md").write_text("# x\ny")
    doc = artifacts.read_documents(spark, str(tmp_path / "d.md")).first()
    import hashlib

    assert doc["text"] == "# x\ny" and artifacts.file_digests(spark, str(tmp_path / "d.md")).first()["sha256"] == hashlib.sha256(b"# x\ny").hexdigest()
    (tmp_path / "runs.lst").write_text("# comment\nx.json\n\n/abs/y.json\nx.json\n")
    assert artifacts.run_paths(spark, [str(tmp_path / "runs.lst"), "/z.json"]) == [f"{tmp_path}/x.json", "/abs/y.json", "/z.json"]
    pages = lambda *x: spark.createDataFrame(list(x), "url string, html string")
    at = str(tmp_path / "pages")
    assert artifacts.store_new(pages(("a", "1"), ("b", "1")), at, "url").count() == 2
    assert artifacts.store_new(pages(("b", "2"), ("c", "2")), at, "url").count() == 1
    assert {tuple(r) for r in spark.read.parquet(at).collect()} == {("a", "1"), ("b", "1"), ("c", "2")}
    artifacts.store_new(pages(("b", "3")), at, "url", overwrite=True)
    assert {tuple(r) for r in spark.read.parquet(at).collect()} == {("a", "1"), ("b", "3"), ("c", "2")}
    artifacts.write_jsonl(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "out"), ascii_only=True)
    line = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json")).strip()
    assert json.loads(line) == {"a": "é", "b": None} and line.isascii()
    artifacts.write_documents(spark.createDataFrame([("d", "t", "body")], "document_id string, title string, markdown string"), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs" / "manifest")).columns == ["document_id", "title"]


def test_test_sets_are_checked(spark):
    rows = spark.createDataFrame([("1", "q", [("b",), ("a",), ("b",)]), ("2", " ", [("a",)]), ("3", "q", [])], "query_id string, query string, chunks array<struct<chunk_id:string>>")
    _, qrels, bad = artifacts.test_set(rows)
    assert sorted(tuple(r) for r in qrels.collect()) == [("1", "a", 2), ("1", "b", 1)]
    assert {tuple(r) for r in bad.collect()} == {("2", "no query"), ("3", "no relevant chunk")}
    assert artifacts.test_set(rows, needed=False)[0].count() == 2


def test_metrics_tell_prefix_queries_apart(spark):
    """On a few documents, queries of few characters find less than whole ones: the metrics discriminate."""
    docs = spark.createDataFrame([(k, f"common words at the start and then topic{k} alone") for k in range(30)], "id int, text string")
    qrels = spark.createDataFrame([(k, k) for k in range(30)], "query_id int, id int")
    at = {}
    for size in (20, 200):
        queries = docs.select(F.col("id").alias("query_id"), F.substring("text", 1, size).alias("query"))
        found = bm25.top_k(docs, queries, 5, "id", "text", "query_id", "query")
        at[size] = metrics.summary(metrics.per_query(found, qrels, [5])).first()["recall_at_k"]
    assert at[200] == 1 and at[20] < 0.3


def test_seeded_order_is_the_same_everywhere(spark):
    pick = lambda n: [r["id"] for r in curation.seeded(spark.range(100).repartition(n), 10, 4, "id").collect()]
    assert pick(1) == pick(5) and len(pick(2)) == 10
