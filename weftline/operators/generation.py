"""Grounded prompts, answers by a provider, judgements and their summaries; whole query sets as tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, shorten
from ..sources.tables import scratch, settled
from ..sources.versioned import VersionedTable

MAX_CHUNK_CHARS = 1600
#: What a prompt and a judge's prompt say around their parts; both may be replaced.
INSTRUCTION = "Use the numbered excerpts below and nothing else to answer. Where they do not hold the answer, name what they lack."
JUDGE_PARTS = ("Asked:", "Excerpts given:", "Excerpt", "Answer to be judged:", "Points a good answer makes:")
NOTHING = "No chunks retrieved."
CRITERIA = ["context_relevance", "groundedness", "answer_relevance"]
JUDGEMENT = "struct<" + ",".join(f"{c}:struct<explanation:string,score:int>" for c in CRITERIA) + ">"
ERRORS = ["retrieval_error", "generation_error", "judge_error"]


class Provider(Protocol):
    """Answers chat messages; one is made for each task."""

    def generate(self, messages: list[dict[str, str]]) -> str: ...


class ExtractiveProvider:
    """Offline stand-in, no model: the first retrieved text of the prompt."""

    def generate(self, messages: list[dict[str, str]]) -> str:
        for line in messages[-1]["content"].splitlines():
            if line.startswith("Text: "):
                return line.removeprefix("Text: ")
        return NOTHING


def context_block(rank: Column, title: Column, section: Column, source: Column, text: Column, limit: int = MAX_CHUNK_CHARS) -> Column:
    """One retrieved chunk as the prompt shows it."""
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] Title: "), title, F.lit("\nSection: "), section, F.lit("\nSource: "), source, F.lit("\nText: "), shorten(collapse(text), limit)
    )


def prompts(queries: DataFrame, retrieved: DataFrame, instruction: str = INSTRUCTION, limit: int = MAX_CHUNK_CHARS) -> DataFrame:
    """query_id, query and user_prompt; retrieved has query_id, rank, title, section, source_url and text, a few rows a query."""
    block = context_block(F.col("rank"), F.col("title"), F.col("section"), F.col("source_url"), F.col("text"), limit)
    blocks = retrieved.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    context = F.coalesce(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit(NOTHING))
    user = F.concat(F.lit(f"{instruction}\n\nAsked:\n"), F.col("query"), F.lit("\n\nExcerpts:\n"), context)
    return queries.join(blocks, "query_id", "left").select("query_id", "query", user.alias("user_prompt"))


def truncated_chunks(retrieved: DataFrame, limit: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Chunks whose text the prompt cuts, with its length."""
    return retrieved.withColumn("text_char_count", F.length(collapse("text"))).where(F.col("text_char_count") > limit)


def judge_prompt(query: Column, texts: Column, answer: Column, points: Column, parts: tuple[str, ...] = JUDGE_PARTS) -> Column:
    """All that a judge sees: the question, the chunks in order, the answer and the points expected of it, each under its heading."""
    asked, given, one, judged_, wanted = parts
    chunks = F.array_join(F.transform(texts, lambda t, k: F.concat(F.lit(f"{one} "), (k + 1).cast("string"), F.lit(":\n"), t)), "\n")
    sections = [(asked, query), (given, chunks), (judged_, answer), (wanted, F.array_join(points, "\n"))]
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{name}\n"), body) for name, body in sections))


def call(rows: DataFrame, prompt_col: str, make_provider: Callable[[], Provider], system: str, answer: str, error: str) -> DataFrame:
    """rows with the provider's answer, or with the error it raised; rows whose prompt is null get neither."""
    names = [c for c in rows.columns if c not in (answer, error)]

    def run(frames) -> Iterator:
        provider = make_provider()
        for frame in frames:
            answers, errors = [], []
            for prompt in frame[prompt_col]:
                got, bad = None, None
                if prompt is not None:
                    try:
                        got = provider.generate([{"role": "system", "content": system}, {"role": "user", "content": prompt}])
                    except Exception as raised:  # whatever a provider raises belongs to its row
                        bad = str(raised)
                answers.append(got), errors.append(bad)
            yield frame.assign(**{answer: answers, error: errors})

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), f"`{answer}` string", f"`{error}` string"])
    return rows.select(*names).mapInPandas(run, schema)


class AnswerLog:
    """Answers by the hash of settings, system text and prompt, kept under a path: what was answered is not asked again.

    Prompts that the log lacks are asked once each, in slices that are committed one after another; a run that breaks off has
    lost its slice alone, and a second run asks nothing. Failed prompts are not kept, so the next run asks them again.
    settings says what else an answer depends on, as the model and its temperature.
    """

    def __init__(self, spark: SparkSession, path: str, settings: str = "", slice_size: int = 10_000, buckets: int = 16):
        self.spark, self.settings, self.slice_size = spark, settings, slice_size
        self.table = VersionedTable(spark, path, "key", buckets)

    def _known(self, keys: DataFrame) -> DataFrame:
        return self.table.lookup(keys) if self.table.version() else self.spark.createDataFrame([], "key string, answer string")

    def call(self, rows: DataFrame, prompt_col: str, make_provider: Callable[[], Provider], system: str, answer: str, error: str) -> DataFrame:
        """As call(): rows with the answer or the error of their prompt; rows whose prompt is null get neither."""
        names = [c for c in rows.columns if c not in (answer, error)]
        name = "key"
        while name in names:
            name += "_"
        digest = F.sha2(F.concat_ws("\x1f", F.lit(self.settings), F.lit(system), F.col(prompt_col)), 256)
        own = settled(rows.select(*names, F.when(F.col(prompt_col).isNotNull(), digest).alias(name)))
        asked = settled(own.where(F.col(name).isNotNull()).select(F.col(name).alias("key"), F.col(prompt_col).alias("prompt")).dropDuplicates(["key"]))
        new = settled(asked.join(self._known(asked), "key", "left_anti"))
        parts = -(-new.count() // self.slice_size)
        failed = self.spark.createDataFrame([], "key string, error string")
        for part in range(parts):
            path = scratch(self.spark, "answers")
            call(new.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part), "prompt", make_provider, system, "answer", "error").write.parquet(path)
            got = self.spark.read.parquet(path)
            failed = failed.unionByName(got.where("error IS NOT NULL").select("key", "error"))
            self.table.upsert(got.where("error IS NULL").select("key", "answer"))
        found = self._known(asked).select(F.col("key").alias(name), F.col("answer").alias(answer))
        return own.join(found, name, "left").join(failed.select(F.col("key").alias(name), F.col("error").alias(error)), name, "left").drop(name)


def judged(rows: DataFrame, raw: str = "judge_raw") -> DataFrame:
    """rows with judge_evaluation read from JSON: exactly the three criteria, each with an explanation and a score of 1 to 5; else judge_error."""
    parsed = F.from_json(F.col(raw), JUDGEMENT)
    exact = F.array_sort(F.json_object_keys(F.col(raw))) == F.array(*map(F.lit, sorted(CRITERIA)))
    sound = exact
    for c in CRITERIA:
        inner = F.get_json_object(F.col(raw), f"$.{c}")
        sound = sound & (F.array_sort(F.json_object_keys(inner)) == F.array(F.lit("explanation"), F.lit("score"))) & parsed[c]["score"].between(1, 5) & parsed[c]["explanation"].isNotNull()
    good = F.coalesce(sound, F.lit(False))
    bad = F.when(F.col(raw).isNotNull() & ~good, F.lit("the judgement does not have the form asked for"))
    old = F.col("judge_error") if "judge_error" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("judge_evaluation", F.when(good, parsed)).withColumn("judge_error", F.coalesce(old, bad))


def evaluate(queries: DataFrame, retrieved: DataFrame, answerer: Callable[[], Provider], judge: Callable[[], Provider], system: str = "", judge_system: str = "", limit: int = MAX_CHUNK_CHARS, log: AnswerLog | None = None) -> DataFrame:
    """A row a query: answer, judgement, and the error of the stage that failed; later stages of it are null.

    queries may have retrieval_error and expected_answer_points. With a log, prompts that it has answers for are not asked.
    """
    ask = log.call if log else call
    own = queries if "retrieval_error" in queries.columns else queries.withColumn("retrieval_error", F.lit(None).cast("string"))
    own = own if "expected_answer_points" in own.columns else own.withColumn("expected_answer_points", F.array().cast("array<string>"))
    texts = retrieved.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", shorten(collapse("text"), limit).alias("text")))).alias("chunks"))
    asked = prompts(own.select("query_id", "query"), retrieved, limit=limit).select("query_id", "user_prompt")
    rows = own.join(asked, "query_id").join(texts, "query_id", "left").withColumn("user_prompt", F.when(F.col("retrieval_error").isNull(), F.col("user_prompt")))
    answered = ask(rows, "user_prompt", answerer, system, "generated_answer", "generation_error")
    shown = F.coalesce(F.transform("chunks", lambda c: c["text"]), F.array().cast("array<string>"))
    asked = answered.withColumn("judge_prompt", F.when(F.col("generated_answer").isNotNull(), judge_prompt(F.col("query"), shown, F.col("generated_answer"), F.col("expected_answer_points"))))
    return judged(ask(asked, "judge_prompt", judge, judge_system, "judge_raw", "judge_error")).drop("user_prompt", "judge_prompt", "judge_raw", "chunks")


def summary(rows: DataFrame) -> DataFrame:
    """Numbers of judged and failed rows, mean scores of the judged ones (null if none), and numbers of non-empty errors by stage."""
    means = [F.round(F.avg(F.col("judge_evaluation")[c]["score"]), 6).alias(f"avg_{c}") for c in CRITERIA]
    errors = [F.count_if(F.length(e) > 0).alias(e) for e in ERRORS]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("judge_evaluation").isNotNull()).alias("n_successful"), F.count_if(F.col("judge_evaluation").isNull()).alias("n_failed"), *means, *errors)


def latency_summary(df: DataFrame, col: str, *by: str) -> DataFrame:
    """count, total, average, least and most; none: 0, 0.0 and nulls."""
    six = lambda x, name: F.round(x, 6).alias(name)
    return df.groupBy(*by).agg(F.count(col).alias("count"), six(F.coalesce(F.sum(col), F.lit(0.0)), "total"), six(F.avg(col), "average"), six(F.min(col), "min"), six(F.max(col), "max"))


def judgement(scores: dict[str, int], explanation: str = "") -> str:
    """A judgement in the form asked for, for tests and stand-ins."""
    return json.dumps({c: {"explanation": explanation, "score": scores[c]} for c in CRITERIA})
