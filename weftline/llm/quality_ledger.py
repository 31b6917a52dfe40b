"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document; the ledger keeps the measurements and one bit for each rule that failed. A
policy is a named, versioned set of bits, so applying another policy, or asking what a policy would keep without one of
its rules, is bit arithmetic over the ledger and never reads a text again. Column functions only: no Python, no shuffle;
windows of words are found by sorting hashes of them inside the row.

Defined results: a null or empty text has no words, fails `few_words` and no other rule; repeated rows each give a row;
columns of any other names pass through `ledger` unchanged, while columns named like its measurements are replaced; a very long
text is measured whole, its windows in one row's array; an empty table
gives an empty ledger, and ablations of it have zero counts. Two different windows are taken as equal if their 64-bit
hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Characters that separate words.
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits, over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Versioned policies: the rules that each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbol_heavy", "duplicate_lines"),
    "web-2": tuple(RULES),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def mask(policy: str) -> int:
    return sum(BIT[rule] for rule in POLICIES[policy])


def _repeated(words: str) -> Column:
    """Windows of three words as hashes with their places, in the order of the hashes."""
    windows = F.expr(f"""
        sort_array(transform(sequence(0, size({words}) - 3),
            i -> struct(xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)) AS h, i AS i)))""")
    return F.when(F.size(words) < 4, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(windows)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements, by column functions over the whole text."""
    names = S.others(docs, *MEASURES)
    kept = [S.quoted(c) for c in names]
    words, lines, spaces, length, places = S.apart([*names, *MEASURES], "words", "lines", "spaces", "length", "places")
    body = F.coalesce(S.quoted(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACE))
    split = docs.select(
        *kept,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias(words),
        F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "").alias(lines),
        (F.length(body) - F.length(F.translate(body, SPACE, ""))).alias(spaces),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(body).alias(length),
    )
    windows = split.select(
        *kept, "n_symbols", F.size(words).cast("long").alias("n_words"), (F.col(length) - F.col(spaces)).cast("long").alias("word_chars"),
        F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated(words).alias(places),
    )
    twice = windows.withColumn(places, F.expr(f"""
        sort_array(transform(filter({places}, (w, k) -> w.h = get({places}, k - 1).h OR w.h = get({places}, k + 1).h), w -> w.i))"""))
    covered = F.expr(f"aggregate({places}, struct(-3 AS at, 0L AS n), (a, i) -> struct(i AS at, a.n + least(3, i - a.at) AS n), a -> a.n)")
    return twice.select(*kept, *(c for c in MEASURES if c != "n_repeat_words"), covered.alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measurements and failed_bits, each rule evaluated once."""
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measured(docs, text).withColumn("failed_bits", bits.cast("long"))


def apply_policy(of_ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return of_ledger.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(of_ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents it fails, documents only it fails, and what the policy keeps with and without it.

    Documents with equal bits are counted together first: at most 2 ** rules groups.
    """
    whole = mask(policy)
    groups = of_ledger.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    has = lambda bits: F.col("failed_bits").bitwiseAND(F.lit(bits)) != 0
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), *(x.alias(a) for a, x in (
        ("n_failed", F.col(f"f_{r}")), ("n_only", F.col(f"o_{r}")), ("n_kept", F.col("kept")), ("n_kept_without", F.col("kept") + F.col(f"o_{r}"))))) for r in POLICIES[policy]))
    one = groups.agg(count(~has(whole)).alias("kept"), *(count(has(BIT[r])).alias(f"f_{r}") for r in POLICIES[policy]), *(count(has(BIT[r]) & ~has(whole & ~BIT[r])).alias(f"o_{r}") for r in POLICIES[policy]))
    return one.select(F.inline(rules))


def op1(spark, sf_dir: str) -> DataFrame:
    """Every document's stored bits judged by the newest policy, and by the two before it; base_failed is that of base-1."""
    stored = S.cut(ledger(S.documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "ledger")
    older = apply_policy(stored, "web-1").withColumnRenamed("kept", "kept_web_1")
    judged = apply_policy(older, "web-2")
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base-1"))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "kept_web_1", "failed_bits")


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """For every policy and rule of it what the policy keeps with and without the rule, from one stored ledger."""
    stored = S.cut(ledger(S.documents(spark, sf_dir).select("doc_id", "text")).select("failed_bits"), "ledger")
    parts = [ablations(stored, policy).withColumn("policy", F.lit(policy)) for policy in POLICIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("policy", "rule", "n_failed", "n_only", "n_kept", "n_kept_without")


#: The same rows by another way: windows as strings, grouped over the whole table.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + d) AS n FROM p, (VALUES (0), (1), (2)) AS v(d) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (100 * n_dup_lines > 40 * n_lines)::BIGINT + 16 * (word_chars < 3 * n_words)::BIGINT + 32 * (word_chars > 12 * n_words)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept,
       (failed_bits & 15) = 0 AS kept_web_1, failed_bits FROM f
"""
ABLATIONS_SQL = (
    SQL.rsplit("SELECT doc_id", 1)[0]
    + """, rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbol_heavy', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32)),
policies(policy, bits) AS (VALUES ('base-1', 3), ('web-1', 15), ('web-2', 63))
SELECT policy, rule, (SELECT count(*) FROM f WHERE failed_bits & bit <> 0) AS n_failed, (SELECT count(*) FROM f WHERE failed_bits & bits = bit) AS n_only,
       (SELECT count(*) FROM f WHERE failed_bits & bits = 0) AS n_kept, (SELECT count(*) FROM f WHERE failed_bits & bits IN (0, bit)) AS n_kept_without
FROM policies JOIN rules ON bits & bit <> 0
"""
)
