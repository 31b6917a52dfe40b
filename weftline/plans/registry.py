"""Queries of the library's own operators over the driver's tables, each beside DuckDB SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import anchors, bm25, chunking, curation, filters, fusion, generation, html, ivf, labels, metrics, vector
from ..sources import tables
from . import pipeline as plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "eval_metrics_by_k"

K, KS = 10, [1, 3, 5, 10]


def query(sql: str | None = None):
    """Register a function (read, where read(name) is a table) under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- shared parts, in columns and in SQL

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def bm25_sql(source: str, key: str, queries: str) -> str:
    """CTEs up to score(query_id, id, score)."""
    return f"""
    own AS (SELECT {key} AS id, {WORDS.format("text")} AS words FROM {source}),
    post AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(words) AS token FROM own) GROUP BY ALL),
    size AS (SELECT id, len(words) AS dl FROM own), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size),
    freq AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
    wanted AS (SELECT query_id, unnest(list_distinct({WORDS.format("query")})) AS token FROM ({queries})),
    score AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
        FROM wanted JOIN post USING (token) JOIN freq USING (token) JOIN size USING (id), corpus GROUP BY ALL)"""


def ranked_sql(score: str, k: int) -> str:
    return f"SELECT query_id, id, rank, -score AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {score}) WHERE rank <= {k}"


PASSAGES = "SELECT item_id AS query_id, text AS query FROM benchmark"
OVER_DOCS = "WITH" + bm25_sql("documents", "doc_id", PASSAGES)


def passages(read) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def keyword(read, k: int = K, queries: DataFrame | None = None, **more) -> DataFrame:
    return bm25.top_k(read("documents"), queries if queries is not None else passages(read), k, "doc_id", "text", "query_id", "query", **more)


def shared_terms(read, k: int = K, queries: DataFrame | None = None, index=None) -> DataFrame:
    """A second component: the share of the query's distinct terms that a document has."""
    wanted = bm25.query_terms(queries if queries is not None else passages(read), "query_id", "query")
    return bm25.shared(index or bm25.searchable(read("documents"), wanted, "doc_id", "text"), wanted, k)


SHARED = f"""
    has AS (SELECT doc_id AS id, unnest(list_distinct({WORDS.format("text")})) AS token FROM documents),
    n_wanted AS (SELECT query_id, count(*) AS n FROM wanted GROUP BY 1),
    share AS (SELECT query_id, id, round(count(*) / any_value(n)::DOUBLE, 6) AS score FROM has JOIN wanted USING (token) JOIN n_wanted USING (query_id) GROUP BY ALL),
    a AS ({ranked_sql("score", K)}), b AS ({ranked_sql("share", K)}),
    both_lists AS (SELECT *, 'bm25' AS component, 0 AS place FROM a UNION ALL SELECT *, 'shared' AS component, 1 AS place FROM b)"""


def components(read, queries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Both components over the same shards."""
    wanted = bm25.query_terms(queries if queries is not None else passages(read), "query_id", "query")
    index = bm25.searchable(read("documents"), wanted, "doc_id", "text")
    return {"bm25": keyword(read, queries=queries, index=index), "shared": shared_terms(read, queries=queries, index=index)}


def integer(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# ---------------------------------------------------------------- keyword retrieval


@query(OVER_DOCS + ranked_sql("score", K))
def bm25_topk(read):
    return integer(keyword(read), "rank")


@query(OVER_DOCS + f""", over AS ({ranked_sql("score", 10 * K)})
    SELECT query_id, id, rank, distance FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
    FROM over SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 200) AS d ON d.doc_id = over.id) WHERE rank <= {K}""")
def bm25_topk_filtered_post(read):
    where = filters.payload([filters.parse("lang=en"), filters.parse("n_chars > 200")])
    return integer(keyword(read, where=where), "rank")


@query(OVER_DOCS + f""", allowed AS (SELECT score.* FROM score SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 200) AS d ON d.doc_id = score.id)
    {ranked_sql("allowed", K)}""")
def bm25_topk_filtered_pre(read):
    where = filters.payload([filters.parse("lang=en"), filters.parse("n_chars > 200")])
    return integer(keyword(read, where=where, mode="exact"), "rank")


@query(f"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({WORDS.format('text')})) AS token FROM documents) GROUP BY 1")
def bm25_term_stats(read):
    return bm25.build(read("documents"), "doc_id", "text").tokens


@query(f"SELECT doc_id AS id, len({WORDS.format('text')})::BIGINT AS dl FROM documents")
def bm25_doc_stats(read):
    return bm25.build(read("documents"), "doc_id", "text").documents


@query()
def bm25_stemmed_topk(read):
    from ..functions.stem import stemmed

    return integer(keyword(read, analyze=bm25.analyzer(stem=stemmed)), "rank")


# ---------------------------------------------------------------- vectors

NEAR = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
    d AS (SELECT query_id, vec_id AS id, round(1 - list_dot_product(v, embedding::DOUBLE[]), 6) AS distance FROM q, embeddings {})
    SELECT query_id, id, rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 10"""


def vector_queries(read) -> DataFrame:
    return read("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(NEAR.format(""))
def vector_topk_cosine(read):
    return integer(vector.top_k(read("embeddings"), vector_queries(read), K, "vec_id", "embedding", "query_id", "vector"), "rank")


@query(NEAR.format("WHERE label IN (1, 2, 3)"))
def vector_topk_filtered(read):
    own = filters.apply(read("embeddings"), where={"label": {"$in": [1, 2, 3]}})
    return integer(vector.top_k(own, vector_queries(read), K, "vec_id", "embedding", "query_id", "vector"), "rank")


@query()
def lsh_topk(read):
    return integer(vector.lsh_top_k(read("embeddings"), vector_queries(read), K, "vec_id", "embedding", "query_id", "vector"), "rank")


@query(NEAR.format(""))
def ivf_topk(read):
    own = read("embeddings")
    index = ivf.build(own, "vec_id", "embedding", tables.scratch(own.sparkSession, "ivf"))
    return integer(index.top_k(vector_queries(read), K, "query_id", "vector"), "rank")


# ---------------------------------------------------------------- fusion and reranking


def rrf_sql(a: float, b: float) -> str:
    return OVER_DOCS + f""", {SHARED}, fused AS (SELECT query_id, id, round(sum(CASE component WHEN 'bm25' THEN {a}::DOUBLE ELSE {b}::DOUBLE END / (60 + rank)), 12) AS score,
        arg_max(component, CASE component WHEN 'bm25' THEN {a}::DOUBLE ELSE {b}::DOUBLE END / (60 + rank) - 1e-9 * place) AS best_component FROM both_lists GROUP BY ALL)
    SELECT query_id, id, rank, -score AS distance, best_component FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= {K}"""


@query(rrf_sql(0.5, 0.5))
def hybrid_rrf(read):
    return integer(fusion.weighted_rrf(components(read), K), "rank").select("query_id", "id", "rank", "distance", "best_component")


@query(rrf_sql(0.7, 0.3))
def hybrid_rrf_weighted(read):
    weights = fusion.parse_weights(["bm25=0.7", "shared=0.3"])
    return integer(fusion.weighted_rrf(components(read), K, weights), "rank").select("query_id", "id", "rank", "distance", "best_component")


@query(OVER_DOCS + f""", {SHARED}, firsts AS (SELECT query_id, id, min(place * 1000 + rank) AS spot FROM both_lists GROUP BY ALL)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY spot, id) AS rank, (row_number() OVER (PARTITION BY query_id ORDER BY spot, id))::DOUBLE AS distance FROM firsts""")
def hybrid_union(read):
    return integer(fusion.union(components(read)), "rank").select("query_id", "id", "rank", "distance")


@query(OVER_DOCS + f""", {SHARED} SELECT query_id, id, max(CASE WHEN place = 0 THEN rank END) AS bm25_rank, max(CASE WHEN place = 1 THEN rank END) AS shared_rank,
    max(CASE WHEN place = 0 THEN distance END) AS bm25_distance, max(CASE WHEN place = 1 THEN distance END) AS shared_distance FROM both_lists GROUP BY ALL""")
def component_provenance(read):
    got = fusion.weighted_rrf(components(read))
    at = lambda m, c: F.try_element_at(F.col(m), F.lit(c))
    return got.select("query_id", "id", at("component_ranks", "bm25").cast("long").alias("bm25_rank"), at("component_ranks", "shared").cast("long").alias("shared_rank"), at("component_distances", "bm25").alias("bm25_distance"), at("component_distances", "shared").alias("shared_distance"))


@query(OVER_DOCS + f""", cand AS ({ranked_sql("score", 30)}), scored AS (SELECT query_id, id, cand.rank AS original_rank,
        round(len(list_intersect({WORDS.format("b.text")}, {WORDS.format("d.text")})) / len(list_distinct(list_concat({WORDS.format("b.text")}, {WORDS.format("d.text")})))::DOUBLE, 6) AS rerank_score
        FROM cand JOIN documents AS d ON d.doc_id = id JOIN benchmark AS b ON b.item_id = query_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank, id) AS rank FROM scored) WHERE rank <= 5""")
def rerank_lexical(read):
    texts = read("documents").select(F.col("doc_id").alias("id"), "text")
    pipe = plans.Pipeline([plans.KeywordComponent(read("documents"), "doc_id")], scorer=lambda q, t: fusion.jaccard(tx.terms(q), tx.terms(t)), texts=texts)
    got = pipe.retrieve(plans.Request(passages(read), 5, 30))
    return integer(got, "rank", "original_rank").select("query_id", "id", "original_rank", "rerank_score", "rank")


@query(OVER_DOCS + f""", {SHARED} SELECT query_id, id, round(distance, 1) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 1), id) AS rank FROM b""")
def tie_stabilize(read):
    return integer(metrics.stabilize_ties(shared_terms(read).withColumn("distance", F.round("distance", 1))), "rank").select("query_id", "id", "distance", "rank")


# ---------------------------------------------------------------- chunks

CHUNKS = f"""chunks AS (SELECT doc_id || '::' || lpad(i::VARCHAR, 4, '0') AS chunk_id, doc_id AS document_id, i AS chunk_index, 900 * i AS start, least(900 * i + 1000, length(text)) AS "end", substr(text, 900 * i + 1, 1000) AS text
    FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 900.0))::BIGINT + 1)) AS i FROM documents WHERE text IS NOT NULL))"""
COUNTED = r"counted AS (SELECT chunk_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS token_count FROM chunks)"


def chunks(read) -> DataFrame:
    return chunking.fixed_windows(read("documents"), "doc_id", "text")


def counted(read) -> DataFrame:
    return chunks(read).select("chunk_id", tx.word_count("text").cast("long").alias("token_count"))


@query(f"""WITH {CHUNKS} SELECT chunk_id, document_id, chunk_index, start, "end", md5(text) AS digest FROM chunks""")
def chunk_fixed_window(read):
    return integer(chunks(read), "chunk_index").select("chunk_id", "document_id", "chunk_index", "start", "end", F.md5("text").alias("digest"))


@query(f"""WITH {CHUNKS}, {COUNTED} SELECT count(*) AS count, min(token_count) AS min, median(token_count) AS median, list_sort(list(token_count))[floor((count(*) - 1) * 0.9::DOUBLE)::BIGINT + 1] AS p90,
    list_sort(list(token_count))[floor((count(*) - 1) * 0.95::DOUBLE)::BIGINT + 1] AS p95, max(token_count) AS max FROM counted""")
def chunk_token_stats(read):
    return chunking.token_stats(counted(read))


@query(f"""WITH {CHUNKS}, {COUNTED} SELECT count(*) AS count, min(token_count) AS min, max(token_count) AS max, round(avg(token_count), 6) AS mean,
    {", ".join(f"round(quantile_cont(token_count, {q}), 6) AS p{round(q * 100):02d}" for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))} FROM counted""")
def chunk_token_distribution(read):
    return chunking.distribution(counted(read), "token_count")


@query(f"""WITH {CHUNKS}, {COUNTED}, ends AS (SELECT min(token_count) AS low, greatest(max(token_count), min(token_count) + 1) AS high FROM counted),
    binned AS (SELECT least(floor((token_count - low) * 40 / (high - low)::DOUBLE), 39)::BIGINT AS bin, count(*) AS n FROM counted, ends GROUP BY 1)
    SELECT i AS bin, coalesce(n, 0) AS n, (sum(coalesce(n, 0)) OVER (ORDER BY i))::BIGINT AS cumulative FROM range(40) AS r(i) LEFT JOIN binned ON bin = i""")
def chunk_histogram(read):
    return integer(chunking.histogram(counted(read), "token_count", 40), "bin")


@query()
def chunk_hierarchical(read):
    docs, _ = html.documents(read("pages").where("page_id IS NOT NULL"), ["article"], closed=True)
    got, _ = chunking.chunk_markdown(docs.withColumnRenamed("page_id", "document_id"), max_tokens=120, overlap_tokens=20)
    return got.select("chunk_id", "document_id", "chunk_index", F.array_join("heading_path", " > ").alias("section"), "start", "end", "token_count")


# ---------------------------------------------------------------- spans, labels, metrics

FIRST = """spans AS (SELECT item_id AS needle_id, doc_id AS id, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + length(b.text) AS "end" FROM benchmark AS b JOIN documents AS d ON contains(d.text, b.text))"""


def first_spans(read) -> DataFrame:
    return labels.find_spans(read("documents"), read("benchmark"), "doc_id", "text", "item_id", "text", first=True)


@query(f"WITH {FIRST} SELECT * FROM spans")
def span_lookup_first(read):
    return first_spans(read)


EVERY_SPAN = """SELECT item_id AS needle_id, doc_id AS id, i - 1 AS start, i - 1 + length(needle) AS "end" FROM (
    SELECT item_id, doc_id, d.text, b.text AS needle, unnest(range(1, length(d.text) - length(b.text) + 2)) AS i FROM benchmark AS b JOIN documents AS d ON contains(d.text, b.text)) WHERE substr(text, i, length(needle)) = needle"""


@query(EVERY_SPAN)
def span_lookup_all(read):
    return labels.find_spans(read("documents"), read("benchmark"), "doc_id", "text", "item_id", "text")


@query(EVERY_SPAN)
def span_lookup_anchors(read):
    """span_lookup_all by rare grams, for needles of 27 characters and more, and by an automaton for shorter ones."""
    docs, needles = read("documents"), read("benchmark")
    names = ("doc_id", "text", "item_id", "text")
    return anchors.find_spans(docs, needles, *names).unionByName(labels.automaton_spans(docs, needles.where(F.length("text") < anchors.SHORTEST), *names))


OVERLAPS = f"""{FIRST}, {CHUNKS}, answers AS (SELECT needle_id, sum("end" - start) AS answer_chars FROM spans GROUP BY 1),
    met AS (SELECT needle_id AS query_id, chunk_id, sum(greatest(0, least(s."end", c."end") - greatest(s.start, c.start)))::BIGINT AS overlap_chars
        FROM spans AS s JOIN chunks AS c ON c.document_id = s.id AND least(s."end", c."end") > greatest(s.start, c.start) GROUP BY ALL)"""


def targets(read) -> DataFrame:
    return first_spans(read).select(F.col("needle_id").alias("query_id"), F.col("id").alias("target_idx"), F.col("id").alias("document_id"), "start", "end")


@query(f"WITH {OVERLAPS} SELECT query_id, chunk_id, overlap_chars, round(overlap_chars / answer_chars::DOUBLE, 6) AS overlap_score, answer_chars::BIGINT AS answer_chars FROM met JOIN answers ON needle_id = query_id")
def label_overlap(read):
    return labels.map_to_chunks(targets(read), chunks(read)).select("query_id", "chunk_id", "overlap_chars", "overlap_score", "answer_chars")


@query(f"""WITH {FIRST} SELECT printf('%05d', row_number() OVER (ORDER BY needle_id * 1000000000 + id)) AS query_id, needle_id AS item_id, id AS document_id, start, "end", md5(substr(d.text, start + 1, "end" - start)) AS span_digest FROM spans JOIN documents AS d ON d.doc_id = id""")
def golden_set(read):
    own = first_spans(read).join(read("documents").select(F.col("doc_id").alias("id"), "text"), "id").withColumn("order", F.col("needle_id") * 1_000_000_000 + F.col("id"))
    return curation.sequential_ids(own, "order").select("query_id", F.col("needle_id").alias("item_id"), F.col("id").alias("document_id"), "start", "end", F.md5(curation.extract(F.col("text"), F.col("start"), F.col("end"))).alias("span_digest"))


@query(f"""WITH {FIRST}, moved AS (SELECT needle_id, id AS document_id, CASE needle_id % 4 WHEN 1 THEN "end" WHEN 2 THEN -1 ELSE start END AS start, CASE needle_id % 4 WHEN 3 THEN "end" + 1000000 ELSE "end" END AS "end" FROM spans)
    SELECT needle_id, document_id, start, "end", CASE WHEN start < 0 OR start >= "end" THEN 'bad bounds' WHEN "end" > length(text) THEN 'beyond the text' END AS error FROM moved JOIN documents ON doc_id = document_id""")
def validate_spans(read):
    kind = F.col("needle_id") % 4
    moved = first_spans(read).select("needle_id", F.col("id").alias("document_id"), F.when(kind == 1, F.col("end")).when(kind == 2, F.lit(-1)).otherwise(F.col("start")).alias("start"), F.when(kind == 3, F.col("end") + 1_000_000).otherwise(F.col("end")).alias("end"))
    return labels.validate_targets(moved, read("documents").select(F.col("doc_id").alias("document_id"), "text")).select("needle_id", "document_id", "start", "end", "error")


def per_query_sql(results: str) -> str:
    """CTEs up to cut: a row for each query and cutoff, over qrels(query_id, id) and results(query_id, id, rank)."""
    return f""", results AS ({results}), nrel AS (SELECT query_id, count(*) AS num_relevant FROM qrels GROUP BY 1),
    flagged AS (SELECT r.*, (q.id IS NOT NULL)::INT AS rel FROM results AS r LEFT JOIN qrels AS q USING (query_id, id)),
    seen AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM flagged),
    cut AS (SELECT n.query_id, k, num_relevant, coalesce(sum(rel), 0) AS found, min(CASE WHEN rel = 1 THEN rank END) AS first_relevant_rank,
        coalesce(sum(CASE WHEN rel = 1 THEN seen / rank::DOUBLE END), 0) AS precisions, coalesce(sum(CASE WHEN rel = 1 THEN 1 / log2(rank + 1) END), 0) AS gain
        FROM nrel AS n CROSS JOIN (VALUES (1), (3), (5), (10)) AS ks(k) LEFT JOIN seen AS s ON s.query_id = n.query_id AND rank <= k GROUP BY ALL),
    per AS (SELECT query_id, k::BIGINT AS k, num_relevant, found > 0 AS hit, first_relevant_rank, coalesce(1 / first_relevant_rank::DOUBLE, 0) AS reciprocal_rank, found / k::DOUBLE AS precision_at_k, found / num_relevant::DOUBLE AS recall_at_k,
        precisions / least(num_relevant, k) AS average_precision_at_k, gain / list_sum(list_transform(range(1, least(num_relevant, k) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_k FROM cut)"""


AVERAGES = "k, count(*) AS n_queries, round(avg(hit::INT), 6) AS hit_rate_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(reciprocal_rank), 6) AS mrr_at_k, round(avg(average_precision_at_k), 6) AS map_at_k, round(avg(ndcg_at_k), 6) AS ndcg_at_k"
CHUNK_RUN = f"WITH {OVERLAPS}, qrels AS (SELECT query_id, chunk_id AS id FROM met), {bm25_sql('chunks', 'chunk_id', PASSAGES)}{per_query_sql(ranked_sql('score', 10))}"


def chunk_run(read) -> DataFrame:
    own = chunks(read)
    qrels = labels.map_to_chunks(targets(read), own).select("query_id", F.col("chunk_id").alias("id"))
    found = bm25.top_k(own, passages(read), max(KS), "chunk_id", "text", "query_id", "query")
    return integer(metrics.per_query(found, qrels, KS), "k", "first_relevant_rank")


@query(CHUNK_RUN + f" SELECT query_id, k, num_relevant, hit, first_relevant_rank, {', '.join(f'round({m}, 6) AS {m}' for m in metrics.PER_QUERY)} FROM per")
def eval_per_query_at_k(read):
    return chunk_run(read).withColumns({m: F.round(m, 6) for m in metrics.PER_QUERY})


@query(CHUNK_RUN + f" SELECT {AVERAGES} FROM per GROUP BY k")
def eval_metrics_by_k(read):
    return metrics.summary(chunk_run(read))


DOC_RUN = f"WITH {FIRST}, qrels AS (SELECT needle_id AS query_id, id FROM spans), {bm25_sql('documents', 'doc_id', PASSAGES)}"


@query(f"""{DOC_RUN}, {SHARED}{per_query_sql("SELECT * FROM a")}, one AS (SELECT {AVERAGES} FROM per GROUP BY k), long AS (UNPIVOT one ON hit_rate_at_k, recall_at_k, precision_at_k, mrr_at_k, map_at_k, ndcg_at_k INTO NAME metric VALUE value)
    SELECT 'bm25' AS label, k, metric, value FROM long""")
def run_metrics_long(read):
    qrels = first_spans(read).select(F.col("needle_id").alias("query_id"), "id")
    one = metrics.summary(integer(metrics.per_query(keyword(read), qrels, KS), "k"))
    return metrics.long_form({"bm25": one})


@query(f"""{DOC_RUN}, {SHARED}{per_query_sql("SELECT query_id * 2 + place AS query_id, id, rank FROM both_lists").replace("qrels AS q", "q2 AS q").replace("FROM qrels GROUP", "FROM q2 GROUP").replace(", results AS", ", q2 AS (SELECT query_id * 2 + place AS query_id, id FROM qrels, (VALUES (0), (1)) AS p(place)), results AS")}
    SELECT k, round(avg(ndcg_at_k) FILTER (query_id % 2 = 0), 6) AS bm25_ndcg, round(avg(ndcg_at_k) FILTER (query_id % 2 = 1), 6) AS shared_ndcg FROM per GROUP BY k""")
def run_comparison(read):
    qrels = first_spans(read).select(F.col("needle_id").alias("query_id"), "id")
    runs = {name: metrics.summary(integer(metrics.per_query(found, qrels, KS), "k")) for name, found in components(read).items()}
    long = metrics.long_form(runs).where("metric = 'ndcg_at_k'")
    return long.groupBy("k").agg(*(F.max(F.when(F.col("label") == r, F.col("value"))).alias(f"{r}_ndcg") for r in ("bm25", "shared")))


# ---------------------------------------------------------------- pages and URLs

URL = "regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '')"
PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"


@query(f"SELECT page_id, {URL} AS url FROM pages")
def url_normalize(read):
    return read("pages").select("page_id", urls.normalize_url("url").alias("url"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://[^/?#]+/.') AS ok, CASE WHEN lower(url) LIKE '%for sale%' OR lower(url) LIKE '%for-sale%' THEN 'for sale' WHEN lower(url) LIKE '%news%' THEN 'news' WHEN lower(url) LIKE '%page%' THEN 'page' END AS excluded FROM pages")
def url_scope_filter(read):
    pages = read("pages").withColumn("none", F.array().cast("array<string>"))
    own = urls.is_article_url("url", F.coalesce(urls.part("url", "AUTHORITY"), F.lit("")), "/") & (F.length(urls.part("url", "PATH")) > 1)
    return pages.select("page_id", own.alias("ok"), urls.excluded_phrase("url", F.lit(""), "none", ["for sale", "news", "page"]).alias("excluded"))


@query(f"SELECT page_id, 'help-center-' || regexp_replace(regexp_replace(lower(list_last(string_split({PATH}, '/'))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS document_id FROM pages")
def document_id_slug(read):
    return read("pages").select("page_id", urls.document_id("url").alias("document_id"))


@query(f"SELECT page_id, {URL} AS url FROM pages AS p WHERE page_id % 2 = 1 AND {URL} NOT IN (SELECT {URL} FROM pages WHERE page_id % 2 = 0)")
def incremental_new_urls(read):
    own = read("pages").select("page_id", urls.normalize_url("url").alias("url"))
    return tables.new_only(own.where("page_id % 2 = 1"), own.where("page_id % 2 = 0"), "url")


@query(f"SELECT page_id, (i - 1)::BIGINT AS level, parts[i] AS segment FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS parts FROM pages))")
def breadcrumb_levels(read):
    parts = F.filter(F.split(F.coalesce(urls.part("url", "PATH"), F.lit("")), "/"), lambda x: x != "")
    return integer(read("pages").select("page_id", F.posexplode(parts).alias("level", "segment")), "level")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), 'untitled'), '\s+', ' ', 'g'), '\s+([,.!?;:])', '\1', 'g')) AS title FROM pages")
def page_title_regex(read):
    raw = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return read("pages").select("page_id", tx.normalize_whitespace(F.coalesce(F.nullif(raw, F.lit("")), F.lit("untitled"))).alias("title"))


# ---------------------------------------------------------------- filters, keys, prompts, summaries


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars >= 500 AND lang = 'en' AND source <> 'src3'")
def metadata_filter_dsl(read):
    return filters.apply(read("documents"), [filters.parse(t) for t in ("n_chars>=500", "lang = en", "source!=src3")]).select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang, source FROM documents WHERE source IN ('src1', 'src2', 'src5') AND n_chars <= 3000 AND n_chars > 30")
def where_in_topic(read):
    where = filters.merged(filters.payload([filters.parse("n_chars>30")]), {"source": {"$in": ["src1", "src2", "src5"]}, "n_chars": {"$lte": 3000}})
    return filters.apply(read("documents"), where=where).select("doc_id", "lang", "source")


@query(r"SELECT trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS query_key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def query_key_duplicates(read):
    return curation.duplicate_queries(read("documents"), "text")


@query(f"SELECT doc_id, length({FLAT.format('text')}) AS text_char_count, md5(rtrim(left({FLAT.format('text')}, 1597)) || '...') AS digest FROM documents WHERE length({FLAT.format('text')}) > 1600")
def prompt_truncation(read):
    own = generation.truncated_chunks(read("documents"))
    return integer(own, "text_char_count").select("doc_id", "text_char_count", F.md5(tx.shorten(tx.collapse("text"), 1600)).alias("digest"))


def retrieved(read) -> DataFrame:
    docs = read("documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    return keyword(read, 3).join(docs, "id").select("query_id", "rank", F.concat(F.lit("Document "), F.col("id").cast("string")).alias("title"), F.col("lang").alias("section"), F.col("source").alias("source_url"), "text")


@query(OVER_DOCS + f""", top AS ({ranked_sql("score", 3)}), blocks AS (SELECT query_id, string_agg('[' || rank || '] Title: Document ' || id || chr(10) || 'Section: ' || lang || chr(10) || 'Source: ' || source || chr(10) || 'Text: ' ||
        CASE WHEN length({FLAT.format("text")}) > 1600 THEN rtrim(left({FLAT.format("text")}, 1597)) || '...' ELSE {FLAT.format("text")} END, chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN documents ON doc_id = id GROUP BY 1)
    SELECT b.item_id AS query_id, md5('{generation.INSTRUCTION}' || chr(10) || chr(10) || 'Asked:' || chr(10) || text || chr(10) || chr(10) || 'Excerpts:' || chr(10) || coalesce(context, '{generation.NOTHING}')) AS prompt_digest
    FROM benchmark AS b LEFT JOIN blocks ON query_id = item_id""")
def prompt_assembly(read):
    return generation.prompts(passages(read), retrieved(read)).select("query_id", F.md5("user_prompt").alias("prompt_digest"))


@query(OVER_DOCS + f""", top AS ({ranked_sql("score", 3)}), said AS (SELECT query_id, CASE WHEN length({FLAT.format("text")}) > 1600 THEN rtrim(left({FLAT.format("text")}, 1597)) || '...' ELSE {FLAT.format("text")} END AS answer FROM top JOIN documents ON doc_id = id WHERE rank = 1)
    SELECT item_id AS query_id, md5(coalesce(answer, '{generation.NOTHING}')) AS answer_digest, 3::INTEGER AS groundedness, NULL::VARCHAR AS generation_error, NULL::VARCHAR AS judge_error FROM benchmark LEFT JOIN said ON query_id = item_id""")
def grounded_answers_stub(read):
    scores = generation.judgement(dict.fromkeys(generation.CRITERIA, 3), "stand-in")

    class Judge:
        def generate(self, messages):
            return scores

    rows = generation.evaluate(passages(read), retrieved(read), generation.ExtractiveProvider, Judge)
    return rows.select("query_id", F.md5("generated_answer").alias("answer_digest"), F.col("judge_evaluation.groundedness.score").alias("groundedness"), "generation_error", "judge_error")


@query("""SELECT count(*) AS n_rows, count(quality) AS n_successful, count(*) - count(quality) AS n_failed, round(avg(1 + 4 * quality), 6) AS avg_context_relevance, round(avg(5 - 4 * toxic), 6) AS avg_groundedness,
    round(avg(3 + quality - toxic), 6) AS avg_answer_relevance, 0::BIGINT AS retrieval_error, 0::BIGINT AS generation_error, 0::BIGINT AS judge_error FROM documents LEFT JOIN labels USING (doc_id)""")
def judge_score_summary(read):
    score = lambda x: F.struct(F.lit("").alias("explanation"), x.cast("int").alias("score"))
    raw = F.to_json(F.struct(score(1 + 4 * F.col("quality")).alias("context_relevance"), score(5 - 4 * F.col("toxic")).alias("groundedness"), score(3 + F.col("quality") - F.col("toxic")).alias("answer_relevance")))
    rows = read("documents").select("doc_id").join(read("labels"), "doc_id", "left").withColumn("judge_raw", F.when(F.col("quality").isNotNull(), raw))
    none = F.lit(None).cast("string")
    return generation.summary(generation.judged(rows).withColumns({"retrieval_error": none, "generation_error": none}))


@query("SELECT event_type, count(value) AS count, round(coalesce(sum(value), 0), 2) AS total, round(avg(value), 6) AS average, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1")
def latency_summary(read):
    return generation.latency_summary(read("events"), "value", "event_type").withColumn("total", F.round("total", 2))


from . import corpus_queries  # noqa: E402, F401  (registers its queries)
