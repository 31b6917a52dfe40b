"""Text as column expressions. White space is Unicode's, offsets are 0-based half-open code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that carry no content when they are a whole block.
LOW_VALUE = [
    "yes",
    "no",
    "submit",
    "search",
    "sign up",
    "contact sales",
    "was this article helpful?",
    "tell us more",
    "submit article feedback",
    "-- please choose an option --",
]
WORD = r"[\p{L}\p{N}_]{2,}"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def normalize_whitespace(x: Column | str) -> Column:
    """collapse, and no blank before closing punctuation."""
    return F.btrim(F.regexp_replace(F.regexp_replace(col(x), r"(?U)\s+", " "), r"\s+([,.!?;:])", "$1"))


def slugify(x: Column | str) -> Column:
    """Lower-case ASCII letters and digits, other stretches as one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-"), F.lit("-"))


def artifact_slug(x: Column | str, fallback: str) -> Column:
    """A file-name part: letters, digits, dot, underscore and hyphen; fallback if nothing is left."""
    plain = F.btrim(F.regexp_replace(col(x), "[^A-Za-z0-9._-]+", "-"), F.lit(".-_"))
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(plain), r"\.\.+", "."), F.lit("")), F.lit(fallback))


def query_key(x: Column | str) -> Column:
    """Key under which two phrasings of a query are the same."""
    return collapse(F.regexp_replace(F.lower(col(x)), r"(?U)[^a-z0-9\s]", " "))


def shorten(x: Column | str, limit: int) -> Column:
    """x, or its first characters and three dots where it is longer than limit."""
    return F.when(F.length(col(x)) <= limit, col(x)).otherwise(F.concat(F.rtrim(F.substring(col(x), 1, limit - 3)), F.lit("...")))


def preview(x: Column | str, limit: int = 180) -> Column:
    """One line of x, cut at limit without trimming before the dots."""
    line = collapse(x)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 3), F.lit("...")))


def low_value(x: Column | str) -> Column:
    text = F.lower(normalize_whitespace(x))
    return (F.length(text) < 3) | text.isin(LOW_VALUE)


def plain_heading(x: Column | str) -> Column:
    """Heading text without links and emphasis marks."""
    unlinked = F.regexp_replace(col(x), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.btrim(F.regexp_replace(unlinked, r"[*_`~]", ""))


def same_heading(a: Column | str, b: Column | str) -> Column:
    # lower case and, as caseless comparison has it, ss for ß
    bare = lambda x: F.btrim(F.regexp_replace(F.replace(F.lower(col(x)), F.lit("ß"), F.lit("ss")), r"(?U)\W+", " "))
    return bare(a) == bare(b)


def word_count(x: Column | str) -> Column:
    """Stretches without white space."""
    return F.when(collapse(x) == "", F.lit(0)).otherwise(F.size(F.split(collapse(x), " ")))


def terms(x: Column | str) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(col(x)), F.lit(WORD), F.lit(0))


def first_span(text: Column | str, needle: Column | str) -> Column:
    """start and end of the needle's first place, null if there is none."""
    at = F.call_function("instr", col(text), col(needle))
    return F.when((at > 0) & (F.length(col(needle)) > 0), F.struct((at - 1).cast("long").alias("start"), (at - 1 + F.length(col(needle))).cast("long").alias("end")))


def all_spans(text: Column | str, needle: Column | str) -> Column:
    """start and end of every place of the needle, overlapping ones too."""
    text, needle = col(text), col(needle)
    size = F.length(needle)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substring(text, i, size) == needle)
    found = F.transform(starts, lambda i: F.struct((i - 1).cast("long").alias("start"), (i - 1 + size).cast("long").alias("end")))
    return F.when((size > 0) & (F.call_function("instr", text, needle) > 0), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def overlap(a_start, a_end, b_start, b_end) -> Column:
    """Characters that two spans share; spans that only touch share none."""
    return F.greatest(F.lit(0), F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start)))


def embedding_text(title, headings, content) -> Column:
    """A chunk's text with its title and the headings above it."""
    section = F.when(F.size(col(headings)) > 0, F.concat(F.lit("\nSection: "), F.array_join(col(headings), " > "))).otherwise(F.lit(""))
    return F.concat(F.lit("Title: "), col(title), section, F.lit("\n\n"), F.regexp_replace(col(content), r"(?U)^\s+|\s+$", ""))


def section_label(headings) -> Column:
    return F.when(F.size(col(headings)) > 0, F.array_join(col(headings), " > ")).otherwise(F.lit("(document start)"))


def section_of_json(path) -> Column:
    """The label of a heading path kept as JSON; what is no array of texts counts as none."""
    return section_label(F.coalesce(F.from_json(col(path), "array<string>"), F.array().cast("array<string>")))


def strip_front_matter(x: Column | str) -> Column:
    """The body after a first block between lines of three hyphens."""
    return F.regexp_replace(col(x), r"(?s)\A---\n.*?\n---\n\s*", "")


def front_matter(fields: dict[str, Column]) -> Column:
    """A block of key: JSON lines between lines of three hyphens."""
    lines = [F.concat(F.lit(f"{k}: "), F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def escape_newlines(x: Column | str) -> Column:
    return F.replace(col(x), F.lit("\n"), F.lit("\\n"))
