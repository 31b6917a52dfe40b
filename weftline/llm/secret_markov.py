r"""Secret scans by character Markov models.

Patterns find assigned values, access ids and hex digests. Beyond those, every run of key characters that is long enough
to reach the threshold is scored by two first-order character models, one of random strings and one of ordinary identifiers,
words of four languages, numbers and rules, and is a secret if the log-likelihood ratio is high enough. The models are counts of adjacent characters in labelled
samples; what reaches the plan is one table of log ratios of a fixed size. Column functions only.

Offsets are in code points, ends exclusive. Defined results: a null text counts as empty and has no span; a run that
overlaps a pattern's span is not scored; repeated rows each give a row; `scan` and `masked` keep every column, whatever its
name, but replace `spans` if there is one; a very long text is scanned whole, in time nearly linear in its length and number of
spans; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

KINDS = ["assign", "access", "hex", "markov"]
#: Fixed patterns: kind, the pattern with its value as group 3 (the match is group 2 of the scan), least length of that value.
KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
PATTERNS: dict[str, tuple[str, str, int]] = {
    "assign": (KEYWORD + r"([A-Za-z0-9+/_.=-]+)", KEYWORD + r"[A-Za-z0-9+/_.=-]{8}", 8),
    "access": (r"(AKIA[A-Z0-9]+)", r"AKIA[A-Z0-9]{12}", 16),
    "hex": (r"([0-9a-f]+)", r"[0-9a-f]{32}", 32),
    "markov": (r"([A-Za-z0-9+/_=-]{12,})", r"[A-Za-z0-9+/_=-]{12}", 12),
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Samples of each label that the models are trained on, added to every pair count, and the ratio (nats) that makes a secret.
SAMPLES, SMOOTHING, THRESHOLD = 4000, 0.5, 12.0
#: Numbers in a block of a running fold, and code points in a piece of a text that is masked: what bounds a step's cost in long texts.
SCAN, CUT = 128, 256
#: Fixed parts of ordinary identifiers.
PARTS = (
    "account action address array async average backup balance batch billing block boolean branch buffer builder button cache "
    "calendar category channel client cluster collection column comment commit config connection content context controller "
    "counter country currency customer database dataset default delivery device directory document download element email encoder "
    "endpoint engine entity error event example export factory feature field filter folder format function gateway group handler "
    "header history image import index input instance integer interface invoice item iterator kernel language layout level library "
    "license limit list local location logger manager margin member memory message method metric module monitor network node "
    "notification number object option order output package page parameter parser partition password path payment platform "
    "pointer position prefix price process product profile project property protocol provider query queue random range record "
    "region release report request resource response result route sample schedule schema scope screen search section select "
    "sequence server service session setting signal size socket source stage state status storage stream string style summary "
    "switch symbol system table target template thread ticket timestamp token topic total transaction transfer update upload "
    "user utils value vector version view volume warehouse website widget window worker"
).split()
#: Fixed words of prose, a line for each language: joined, they stand for long and compound words.
PROSE = [
    "the and that with from which their would there about could other these people through between another however thought something "
    "question government international understanding responsibility relationship information knowledge childhood friendship reason "
    "beautiful possible available successful usually certainly immediately already whether during shown anchor ocean season health "
    "should threshold wheat heather shipment nothing everything within although strength length reading tonight history earth sheet",
    "der die das und ein eine einen nicht auch sich mit von auf für aus dem bei nach über wenn noch unter zwischen freiheit sicherheit "
    "gesundheit krankheit einheit möglichkeit wirklichkeit geschwindigkeit tätigkeit schwierigkeit gerechtigkeit entwicklung forschung "
    "versicherung beziehung bedeutung verwaltung zeitung wissenschaft gesellschaft freundschaft wirtschaft gesetz platz schutz "
    "kopf pflicht pfad topf stumpf pflege natürlich eigentlich schließlich menschlich rechtsanwalt geburtstag arbeitsamt zusammen "
    "zuerst aufzug beispiel bericht gebiet dienst schule deutsch wieder sprechen stein bein herz jetzt zeit obst kunst haus auge",
    "les des une dans pour avec qui que sur sont mais nous vous tout plus leur elle comme faire autre entre encore toujours nouveaux "
    "travaux chevaux oiseaux bureaux journaux heureux dangereux nombreux sérieux curieux deux cheveux lieu mieux vieux tableau beauté "
    "question politique publique musique banque quelque chaque lorsque jusque gouvernement développement événement appartement "
    "information situation liberté société université aujourd hui maison raison saison français voiture jour nuit mouvement lumière",
    "los las una por con para como pero sus esta entre cuando todo sobre también hasta desde nosotros algunos mismo otra cada gobierno "
    "ciudad libertad universidad sociedad realidad verdad necesidad información situación educación relación nación canción producción "
    "importante diferente presidente realmente solamente trabajo tiempo persona historia familia semana noche izquierda derecho "
    "precio servicio ejercicio justicia noticia gracias espacio hablado perdido cerrado mercado estado lado todos años días mujer",
]


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """token and label: 1 for strings drawn from a digest's bytes in four alphabets, 0 for joined words with numbers, long words, numbers and rules."""
    row = spark.range(n)
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    dense = F.translate(F.base64(F.unhex(digest)), "+/=", "")
    secret = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, dense).when(F.col("id") % 4 == 2, F.upper(dense)).otherwise(F.lower(dense))
    words = F.array(*map(F.lit, PARTS))
    part = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.pow(F.lit(10), 1 + F.col("id") % 6).cast("long")).cast("string")
    style = F.col("id") % 5
    plain = (
        F.when(style == 0, F.concat_ws("_", part(1), part(2), part(3), number)).when(style == 1, F.concat_ws("-", part(1), part(2), part(3), number))
        .when(style == 2, F.concat(part(1), F.initcap(part(2)), F.initcap(part(3)), number)).when(style == 3, F.upper(F.concat_ws("_", part(1), part(2), number, part(3))))
        .otherwise(F.concat_ws("/", part(1), F.concat_ws("-", part(2), number), part(3)))
    )
    prose = F.array(*(F.array(*map(F.lit, [w for w in line.split() if w.isascii()])) for line in PROSE))
    lang = F.get(prose, F.pmod(F.col("id"), F.lit(4)).cast("int"))
    word = lambda k: F.get(lang, F.pmod(F.xxhash64("id", F.lit(k)), F.size(lang)).cast("int"))
    group = lambda k, size: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**size)).cast("string"), size, "0")
    form = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(16))
    long = (
        F.when(form == 0, F.repeat(F.substring(F.lit("-=_/+"), (1 + F.col("id") % 5).cast("int"), F.lit(1)), F.lit(24)))
        .when(form == 1, F.concat_ws("-", group(11, 4), group(12, 3), group(13, 4))).when(form == 2, F.concat_ws("/", group(11, 2), group(12, 2), group(13, 4), group(14, 5)))
        .when(form == 3, F.concat(F.lit("+"), group(11, 8), group(12, 6))).when(form < 6, F.concat_ws("-", word(11), word(12), word(13)))
        .when(form == 6, F.upper(F.concat(word(11), word(12), word(13)))).when(form < 10, F.initcap(F.concat(word(11), word(12), word(13)))).otherwise(F.concat(word(11), word(12), word(13), word(14)))
    )
    ordinary = row.select(plain.alias("token"), F.lit(0).alias("label")).unionByName(row.select(long.alias("token"), F.lit(0).alias("label")))
    return row.select(secret.alias("token"), F.lit(1).alias("label")).unionByName(ordinary)


def train(samples: DataFrame) -> list[float]:
    """Log ratios of the two models' transition probabilities, by first and second character. Counts of pairs are all that is collected: at most 2 x 67 x 67."""
    pairs = samples.where("length(token) > 1").select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    seen: dict[int, dict[str, int]] = {0: defaultdict(int), 1: defaultdict(int)}
    for label, pair, n in pairs.groupBy("label", "pair").count().collect():
        seen[int(label)][pair] += n
    size, out = len(ALPHABET), []
    for a in ALPHABET:
        totals = [sum(seen[k][a + b] for b in ALPHABET) + SMOOTHING * size for k in (0, 1)]
        out += [math.log((seen[1][a + b] + SMOOTHING) / totals[1]) - math.log((seen[0][a + b] + SMOOTHING) / totals[0]) for b in ALPHABET]
    return out


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scanned(values: Column, op) -> Column:
    """For every number of an array what op (of an associative kind, with 0 for none) makes of those before it.

    Blocks are folded first, so that a number costs a fold over its block and its block a fold over the blocks.
    """
    fold = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: op(a, x))
    block = lambda i: F.floor(i / SCAN).cast("int")
    before = lambda sums: F.transform(sums, lambda x, c: fold(F.slice(sums, F.lit(1), c)))
    inside = lambda v, blocks: F.transform(v, lambda x, i: op(F.get(blocks, block(i)), fold(F.slice(v, block(i) * SCAN + 1, i - block(i) * SCAN))))
    folded = lambda v: F.transform(F.sequence(F.lit(0), block(F.greatest(F.size(v) - 1, F.lit(0)))), lambda c: fold(F.slice(v, c * SCAN + 1, F.lit(SCAN))))
    return let(values, lambda v: let(folded(v), lambda sums: let(before(sums), lambda blocks: inside(v, blocks))))


def ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a run of key characters."""
    places = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    step = lambda a, p: F.struct(p.alias("at"), F.when(a["at"] >= 0, a["sum"] + F.get(table, (a["at"] * len(ALPHABET) + p).cast("int"))).otherwise(a["sum"]).alias("sum"))
    return F.aggregate(places, F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])


def _found(text: Column, kind: str) -> Column:
    """All matches from the left with their values: start and end in code points.

    Each match of the scan starts where the one before has ended and takes the shortest stretch before the next match.
    """
    pattern, may, least = PATTERNS[kind]
    scan = F.lit(rf"\G(?s:.*?)({pattern})")
    whole, match, value = (F.regexp_extract_all(text, scan, F.lit(k)) for k in (0, 1, 2))
    sized = F.transform(F.arrays_zip(whole.alias("w"), match.alias("m"), value.alias("v")), lambda x: F.struct(F.length(x["w"]).alias("w"), F.length(x["m"]).alias("m"), x["v"].alias("v")))
    at = lambda x, before: F.struct((before + x["w"] - x["m"]).alias("start"), (before + x["w"]).alias("end"), x["v"].alias("value"))
    spans = let(sized, lambda z: let(scanned(F.transform(z, lambda x: x["w"]), lambda a, x: a + x), lambda before: F.filter(F.transform(z, lambda x, i: at(x, F.get(before, i))), lambda x: F.length(x["value"]) >= least)))
    return F.when(F.regexp_like(text, F.lit(may)), spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def scan(docs: DataFrame, table: list[float], text: str = "text") -> DataFrame:
    """docs with spans, an array of start, end and kind (its place in KINDS) in ascending order."""
    names = S.others(docs, "spans")
    kept = [S.quoted(c) for c in names]
    body = F.coalesce(S.quoted(text), F.lit(""))
    *of, every = S.apart([*names, "spans"], *KINDS, "every")
    found = docs.select(*kept, *(_found(body, kind).alias(name) for kind, name in zip(KINDS, of, strict=True)))
    ratios = F.lit(table) if table else F.array().cast("array<double>")
    of_kind = lambda k: F.transform(of[k], lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), (x["value"] if k == 3 else F.lit("")).alias("value")))
    own = found.select(*kept, F.sort_array(F.flatten(F.array(*map(of_kind, range(4))))).alias(every))
    # runs don't overlap one another, so a span that begins within a run comes next after it
    free = lambda all_, ends, x, i: (F.get(ends, i) <= x["start"]) & (F.coalesce(F.get(all_, i + 1)["start"], x["end"]) >= x["end"])
    kept_of = lambda all_: let(scanned(F.transform(all_, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.greatest), lambda ends: F.filter(all_, lambda x, i: (x["kind"] < 3) | free(all_, ends, x, i) & (ratio(x["value"], ratios) >= THRESHOLD)))
    spans = F.when(F.size(every) > 0, let(F.col(every), kept_of)).otherwise(F.col(every))
    return own.select(*kept, F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame, table: list[float], text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each span of the text replaced by mask, overlapping spans by one; other columns as they are."""
    found = scan(docs, table, text)
    body = S.quoted(text)
    part = lambda cuts, a, b, k: F.substring(F.get(cuts, k), F.greatest(a - k * CUT, F.lit(0)) + 1, F.least(b, k * CUT + CUT) - F.greatest(a, k * CUT))
    piece = lambda cuts, a, b: F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / CUT).cast("int"), F.floor((b - 1) / CUT).cast("int")), lambda k: part(cuts, a, b, k)), "")).otherwise("")
    # a span that begins before an earlier one has ended belongs to that one's mask
    between = lambda ends: F.filter(F.transform("spans", lambda x, i: F.when(x["start"] >= F.get(ends, i), F.struct(F.get(ends, i).alias("a"), x["start"].alias("b")))), lambda x: x.isNotNull())
    last = F.struct(F.array_max(F.transform("spans", lambda x: x["end"])).alias("a"), F.length(body).alias("b"))
    gaps = F.concat(let(scanned(F.transform("spans", lambda x: x["end"]), F.greatest), between), F.array(last))
    out = let(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), lambda cuts: F.array_join(F.transform(gaps, lambda x: piece(cuts, x["a"], x["b"])), mask))
    return found.withColumn(text, F.when(F.size("spans") > 0, out).otherwise(body)).drop("spans")


def op2(spark, sf_dir: str) -> DataFrame:
    table = train(labelled_samples(spark))
    found = scan(S.documents(spark, sf_dir).select("doc_id", "text"), table)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = joined(F.filter("spans", lambda x: x["kind"] < 3))
    return found.select("doc_id", n(0), n(1), n(2), n(3), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
