"""Pages into titled Markdown in one walk, and chunks whose sizes are sums."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.operators import chunking, html

BODIES = [
    "<h1>Top , here</h1><article><h1>Top , here</h1><p>one <b>two</b> .<p>nested<p>deeper\t x</p></article>",
    "<meta property='og:title' content=' og '><article><ul><li>a<ul><li>b</ul></ul><nav>gone</nav><div class='x hide'>gone</div><pre>k  k</pre></article>",
    "<title>t</title><article><span hidden>gone</span><p aria-hidden='true'>gone</p><table><tr><th>a<td>b</table></article>",
    "<title>no article</title><p>x</p>", "<article></article>", None,
]


def test_documents_equal_blocks_and_metadata(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", b) for k, b in enumerate(BODIES)], "page_id long, url string, html string")
    blocks, failed = html.html_blocks(pages, ["article"])
    want = html.markdown(blocks).join(html.metadata(pages).select("page_id", "title"), "page_id").select("page_id", "title", "markdown")
    good, bad = html.documents(pages, ["article"])
    assert sorted(good.collect()) == sorted(want.collect()) and good.count() == 3
    assert sorted(bad.collect()) == sorted(failed.collect())


def test_broken_breadcrumbs_leave_the_title(spark):
    page = '<script type="application/ld+json">[{"@type": "BreadcrumbList", "itemListElement": null}]</script><h1>T</h1><article><p>some words</p></article>'
    pages = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    assert html.documents(pages, ["article"])[0].first()["title"] == "T"


def test_chunk_hierarchical_walks_a_page_once_and_shuffles_nothing(spark):
    got = entry.queries()["chunk_hierarchical"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2 and "Join" not in plan and "Aggregate" not in plan
    assert got.where(F.col("token_count") > 120).isEmpty() and not got.isEmpty()


class Reading(chunking.WordTokenizer):
    """Tells how many characters it has read."""

    read = 0

    def count(self, text):
        self.read += len(text)
        return super().count(text)

    def spans(self, text):
        self.read += len(text)
        return super().spans(text)


class Plain(Reading):
    adds_up = False


def test_sums_of_tokens_give_the_chunks_of_whole_texts():
    rng = random.Random(3)
    signs = ["# H one\n\n", "## K_\n\n", "word ", "Xé, ", "x. A", "! 1 ", "\n\n", "\n", "- it ", "1. n ", "| a | b |\n", "|---|---|\n", "```py\n", "```\n", "\x1c", "  ", "\r\n"]
    for _ in range(150):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 200)))
        for limit, overlap in ((60, 12), (30, 0)):
            assert found(text, limit, overlap, Reading()) == found(text, limit, overlap, Plain())
    long, told = " ".join(f"Word {k} of a text." for k in range(4000)), Reading()
    assert len(chunking.HierarchicalChunker(told, 120, 20).chunk(long, "T")) > 100
    assert told.read < 3 * len(long)


def found(text, limit, overlap, tokenizer):
    try:
        return chunking.HierarchicalChunker(tokenizer, limit, overlap).chunk(text, "H")
    except ValueError as error:
        return str(error)
