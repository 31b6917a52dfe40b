from datetime import datetime
from zoneinfo import ZoneInfo

import pytest

from weftline.plans import naming
from weftline.sources import crawl

HOST = "help.example.com"


def test_discovery_follows_nested_sitemaps_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    nest = lambda *at: "<sitemapindex>" + "".join(f"<sitemap><loc>{a}</loc></sitemap>" for a in at) + "</sitemapindex>"
    leaf = lambda *at: "<urlset>" + "".join(f"<url><loc>{a}</loc></url>" for a in at) + "</urlset>"
    base = f"https://{HOST}/hc/en-us/articles/"
    rows = [("r", nest("a", "b")), ("a", nest("r", "c")), ("b", leaf(base + "2-x?q=1", base + "1-y")), ("c", leaf(base + "2-x?q=1", "https://other/1", base + "3-dev-mode"))]
    found = crawl.discover(spark.createDataFrame(rows, "url string, xml string"), "r")
    assert [r["url"] for r in found.collect()] == [base + "1-y", base + "2-x?q=1", base + "3-dev-mode", "https://other/1"]
    known = spark.createDataFrame([(base + "1-y",)], "source_url string")
    assert [r["source_url"] for r in crawl.to_fetch(found, known, HOST).orderBy("source_url").collect()] == [base + "2-x", base + "3-dev-mode"]
    assert crawl.to_fetch(found, known, HOST, limit=1).count() == 0 and crawl.to_fetch(found, known, HOST, overwrite=True).count() == 3

    class Shelf:
        def get(self, url):
            if url.endswith("2-x"):
                raise OSError("gone")
            return "<html></html>"

    got = crawl.fetch(crawl.to_fetch(found, known, HOST), Shelf)
    assert {r["source_url"][-3:]: r["error"] for r in got.collect()} == {"2-x": "OSError: gone", "ode": None}
    about = spark.createDataFrame([(base + "3-dev-mode", "T", ["A", "B"]), (base + "1-y", "Some Title", [])], "source_url string, title string, breadcrumbs array<string>")
    rows, left = crawl.manifest(crawl.fetch(crawl.to_fetch(found, known, HOST, overwrite=True), Shelf), about)
    assert [(r["document_id"], r["product_area"]) for r in rows.collect()] == [("help-center-1-y", "some-title")]
    assert [r["excluded"] for r in left.collect()] == ["dev mode"]


def test_names(tmp_path):
    assert naming.index_name("data\\chunks_hierarchical_bge-small_t320_o40_20260630-1601.jsonl", "bm25") == "bm25-hierarchical-bge-small-t320-o40"
    assert naming.index_name("x/other file.jsonl", "p") == "p-other-file" and len(naming.index_name("y" * 99, "p")) <= naming.NAME_LIMIT
    assert naming.slug("..") == "index" and naming.child_of(str(tmp_path), "a").parent == tmp_path.resolve()
    for bad in ("..", ".", "../x"):
        with pytest.raises(ValueError):
            naming.child_of(str(tmp_path), bad)
    (tmp_path / "m.json").touch()
    assert naming.fresh(tmp_path / "m.json").name == "m-1.json" and naming.fresh(tmp_path / "n.json").name == "n.json"
    assert naming.stamp(datetime(2026, 1, 2, 23, 30, tzinfo=ZoneInfo("UTC"))) == "20260103-0030"
    assert naming.run_label({"components": ["vector", "bm25"], "aggregation_strategy": "weighted_rrf", "component_weights": {"vector": 0.7, "bm25": 0.3}, "reranking": {"enabled": True, "model": "org/m"}}) == "vector + bm25 | weighted_rrf | bm25=0.3, vector=0.7 | rerank m"


def test_model_sections():
    got = naming.ModelConfig.parse({"provider": "p", "model": "m", "temperature": 0, "seed": 3})
    assert got.options() == {"model": "m", "temperature": 0, "seed": 3}
    with pytest.raises(ValueError):
        naming.ModelConfig.parse({"provider": "p", "model": " "})
