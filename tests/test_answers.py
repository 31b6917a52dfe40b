"""Answers that are asked for once, and pipelines from queries to judged answers with a model that reranks."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from weftline.operators import generation
from weftline.plans import pipeline as plans

PROMPTS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad"), (6, "c"), (7, "d"), (8, "e"), (9, "f")]


def counting(folder):
    """What makes a provider; local, so that workers need not import this file."""

    class Counting:
        """Writes down each prompt that it is asked; fails on one, and takes its worker down on another while a file says so."""

        def __init__(self, folder):
            self.folder = folder

        def generate(self, messages):
            prompt = messages[-1]["content"]
            with open(f"{self.folder}/asked", "a") as out:
                out.write(prompt + "\n")
            if prompt == "bad":
                raise ValueError("no answer")
            if prompt == "f" and os.path.exists(f"{self.folder}/broken"):
                raise SystemExit(1)
            return prompt.upper()

    return lambda: Counting(folder)


def test_prompts_are_asked_once_even_when_a_run_breaks_off(spark, tmp_path):
    rows = spark.createDataFrame(PROMPTS, "id int, prompt string").repartition(3)
    log = generation.AnswerLog(spark, f"file://{tmp_path}/log", "model-1", slice_size=2, buckets=2)
    folder = str(tmp_path)
    run = lambda log=log: {r.id: (r.answer, r.error) for r in log.call(rows, "prompt", counting(folder), "be brief", "answer", "error").collect()}
    asked = lambda: Counter((tmp_path / "asked").read_text().split())
    (tmp_path / "broken").write_text("")
    with pytest.raises(Exception):
        run()
    paid = set(asked())
    committed = {r.answer.lower() for r in log.table.read().collect()} if log.table.version() else set()
    os.remove(tmp_path / "broken")
    want = {i: (p.upper() if p and p != "bad" else None, "no answer" if p == "bad" else None) for i, p in PROMPTS}
    assert run() == want
    assert all(asked()[p] == 1 for p in committed) and all(n <= 2 for n in asked().values()) and set(asked()) >= paid
    before = asked()
    assert run() == want and asked() - before == Counter(["bad"])  # errors alone are asked again
    assert run(generation.AnswerLog(spark, f"file://{tmp_path}/log", "model-2", buckets=2)) == want and (asked() - before)["a"] == 1


def test_a_pipeline_reranks_by_a_model_and_answers(spark, tmp_path):
    class ByWord:
        def score(self, pairs):
            return [float(text.count(query.split()[0])) for query, text in pairs]

    texts = ["pear one", "pear pear two", "pear pear pear three", "fig"]
    chunks = spark.createDataFrame([(f"c{k}", t, "t", '["a"]', "u") for k, t in enumerate(texts)], "chunk_id string, text string, title string, heading_path string, source_url string")
    config = plans.parse_config({"top_k": 2, "candidate_k": 4, "components": ["bm25"]})
    pipe = plans.build(config, chunks, make_scorer=ByWord, model="by word")
    request = config.request(spark.createDataFrame([(1, "pear")], "query_id int, query string"))
    got = pipe.retrieve(request).orderBy("rank").collect()
    assert [(r.id, r.rerank_score, r.rerank_model) for r in got] == [("c2", 3.0, "by word"), ("c1", 2.0, "by word")] and pipe.description()["reranking"]
    with pytest.raises(ValueError):
        plans.build(config, chunks, scorer=lambda q, t: q, make_scorer=ByWord)
    scores = generation.judgement(dict.fromkeys(generation.CRITERIA, 4))

    class Judge:
        def generate(self, messages):
            return scores

    log = generation.AnswerLog(spark, f"file://{tmp_path}/log", buckets=2)
    for _ in range(2):
        row = plans.answer(pipe, request, chunks, generation.ExtractiveProvider, Judge, log).first()
        assert row.generated_answer == "pear pear pear three" and row.judge_evaluation.groundedness.score == 4 and row.judge_error is None
