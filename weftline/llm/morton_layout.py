r"""Multidimensional clustered layout by Morton codes, and box queries over it by ranges of codes.

Each of several values of a row becomes a coordinate: its rank among all rows, in 16 equal steps. The coordinates' bits are
interleaved to a code, rows are placed by code and cut into files of equal row counts. A box query is split into ranges of
codes: from a code in the box as far as the box goes, then by a jump to the next code in the box. Files that match are those
of the occupied cells in these ranges, found by binary search; files that are touched are those whose bounds meet the box.

What is shared out never grows with the rows: coordinates come from 15 limits a value; a cell's queries are answered once,
in the group of its two exact coordinates, which has at most 16 x 16 cells and (16 x 17 / 2) ** 2 different bounds; a
row meets its file's bounds and its cell's answer by file and cell. Ranks and places are sums over ranges of the order
(`running`), so one value, cell or file may have any share of the rows.

Defined results: a null value is the smallest and has coordinate 0, a null text has length -1, a null id comes first in
its cell; repeated rows have places one after another; equal values share a coordinate however many they are; a very long
text only counts its bytes; other columns pass through `layout`, in place of those named like its results; an empty
table gives an empty layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import running
from . import shared as S

#: Bits of a coordinate, rows of a file.
BITS, FILE_ROWS = 4, 500
#: Coordinates in the order in which a round of bits takes them, and how far a row's query goes on each side.
ORDER = ["length", "source", "date", "lang"]
REACH = {"length": 2, "source": 0, "date": 2, "lang": 0}
#: The order of a file's bounds.
SHOWN = ["source", "lang", "length", "date"]
TYPES = {"source": "string", "lang": "string", "length": "long", "date": "long"}


def values(id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> dict[str, Column]:
    """The four values of a document."""
    return {
        "source": S.quoted(source).cast("string"), "lang": S.quoted(lang).cast("string"),
        "length": F.coalesce(F.octet_length(S.quoted(text)), F.lit(-1)).cast("long"), "date": (S.crc_of_id(id_col) % 365).cast("long"),
    }


# ---------------------------------------------------------------- codes


def masks(dims: int = len(ORDER), bits: int = BITS) -> list[int]:
    """The bits of a code that each coordinate has, in the order of a round."""
    return [sum(1 << (dims * b + dims - 1 - d) for b in range(bits)) for d in range(dims)]


def code(coords: list[Column], bits: int = BITS) -> Column:
    """The coordinates' bits interleaved, the highest of the first one first."""
    dims, out = len(coords), F.lit(0).cast("long")
    for d, c in enumerate(coords):
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), dims * b + dims - 1 - d))
    return out


def coordinate(z: Column, d: int, dims: int = len(ORDER), bits: int = BITS) -> Column:
    """The d-th coordinate of a code."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z, dims * b + dims - 1 - d).bitwiseAND(F.lit(1).cast("long")), b))
    return out


def interleaved(coords: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    dims = len(coords)
    return sum(((c.astype(np.int64) >> b & 1) << (dims * b + dims - 1 - d) for d, c in enumerate(coords) for b in range(bits)), np.zeros(len(coords[0]), np.int64))


def inside(z: np.ndarray, low: np.ndarray, high: np.ndarray, of: list[int]) -> np.ndarray:
    """Whether codes lie in boxes: bits of one coordinate compare as the coordinate does."""
    out = np.ones(len(z), bool)
    for m in of:
        out &= ((z & m) >= (low & m)) & ((z & m) <= (high & m))
    return out


def next_inside(z: np.ndarray, low: np.ndarray, high: np.ndarray, dims: int = len(ORDER), bits: int = BITS) -> np.ndarray:
    """The least code of each box that is not less than z, -1 where there is none. From the highest bit on, z stays between
    the box's corners; where the corners part, the upper half's least code is noted and the half that z is in is gone into."""
    of, low, high = masks(dims, bits), low.copy(), high.copy()
    noted, out, open_ = np.full(len(z), -1, np.int64), np.full(len(z), -1, np.int64), np.ones(len(z), bool)
    for k in range(dims * bits - 1, -1, -1):
        bit, under = np.int64(1) << k, np.int64(of[dims - 1 - k % dims] & ((1 << k) - 1))
        zb, lb, hb = (z & bit) > 0, (low & bit) > 0, (high & bit) > 0
        parted = open_ & ~lb & hb
        over, below = open_ & ~zb & lb, open_ & zb & ~hb
        out = np.where(over, low, np.where(below, noted, out))
        noted = np.where(parted & ~zb, low & ~under | bit, noted)
        high = np.where(parted & ~zb, high & ~bit | under, high)
        low = np.where(parted & zb, low & ~under | bit, low)
        open_ &= ~(over | below)
    return np.where(open_, z, out)


def ranges(low: np.ndarray, high: np.ndarray, dims: int = len(ORDER), bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Boxes by their corners' codes as ranges: numbers of boxes, first and last codes; for each box in ascending order.

    From a code in the box the range goes over the largest block that begins there and lies in the box.
    """
    of, own, z = masks(dims, bits), np.arange(len(low)), low.copy()
    while len(own):
        last = z.copy()
        for k in range(1, dims * bits + 1):
            end = z | ((np.int64(1) << k) - 1)
            grows = ((z & ((np.int64(1) << k) - 1)) == 0) & inside(end, low[own], high[own], of)
            if not grows.any():
                break
            last = np.where(grows, end, last)
        yield own, z, last
        rest = last < high[own]
        own, z = own[rest], last[rest] + 1
        z = next_inside(z, low[own], high[own], dims, bits)
        own, z = own[z >= 0], z[z >= 0]


# ---------------------------------------------------------------- layout


def limits(rows: DataFrame, types: dict[str, str], steps: int = 1 << BITS) -> dict[str, list[tuple[int, object]]]:
    """For each named column the coordinates above 0 that occur, with the least value of each: at most 15 a column."""
    names = list(types)
    of = lambda n: [F.col(n) if types[n] == t else F.lit(None).cast(t) for t in ("string", "long")]
    one = F.array(*(F.struct(F.lit(k).alias("k"), *(c.alias(f"v_{i}") for i, c in enumerate(of(n)))) for k, n in enumerate(names)))
    counts = rows.select(F.inline(one)).groupBy("k", "v_0", "v_1").agg(F.count(F.lit(1)).alias("n"))
    before = running.summed(running.ordered(counts, [F.col("k"), F.col("v_0"), F.col("v_1")], "values"), {"before": "n"})
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    # each column has one value a row, so what stands before a column's first value is k times all rows
    reached = before.crossJoin(total).withColumn("c", F.expr(f"{steps} * (before - k * total) div total")).where("c > 0")
    out: dict[str, list[tuple[int, object]]] = {n: [] for n in names}
    for k, c, text, number in reached.groupBy("k", "c").agg(F.min("v_0"), F.min("v_1")).collect():
        out[names[k]].append((int(c), text if types[names[k]] == "string" else number))
    return {n: sorted(x) for n, x in out.items()}


def stepped(value: Column, of: list[tuple[int, object]]) -> Column:
    """The coordinate of a value: that of the last limit that is not above it."""
    out = F.lit(0)
    for c, least in of:
        out = F.when(value >= F.lit(least), c).otherwise(out)
    return out.cast("long")


def layout(docs: DataFrame, of: dict[str, Column] | None = None, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, rows: int = FILE_ROWS) -> DataFrame:
    """Columns of docs (keep, or all but the text) with the four coordinates (c_length, ...), z, position and file."""
    of = of or values(id_col, text)
    added = [f"c_{n}" for n in ORDER] + ["z", "position", "file"]
    names = [c for c in S.others(docs, *added) if (c in keep if keep is not None else c.lower() != text.lower())]
    own = dict(zip(ORDER, S.apart([*names, *added, "part", "before_n"], *(f"v_{n}" for n in ORDER)), strict=True))
    table = S.cut(docs.select(*map(S.quoted, names), *(of[n].alias(own[n]) for n in ORDER)), "narrow")
    at = limits(table.select(*(F.col(own[n]).alias(n) for n in SHOWN)), {n: TYPES[n] for n in SHOWN})
    coords = table.withColumns({f"c_{n}": stepped(F.col(own[n]), at[n]) for n in ORDER}).withColumn("z", code([F.col(f"c_{n}") for n in ORDER]))
    (mark,) = S.apart([*coords.columns, "part", "before_n"], "at")
    by = [F.col("z"), S.quoted(id_col), *(F.col(own[n]) for n in ORDER)]
    ordered = running.ordered(coords, by, "ordered", mark)
    placed = running.placed(ordered.drop(*own.values()), "position", mark)
    return placed.withColumn("file", F.expr(f"position div {rows}"))


def file_bounds(placed: DataFrame) -> DataFrame:
    """file, and the least and greatest of each coordinate in it."""
    return placed.groupBy("file").agg(*(f(f"c_{n}").alias(f"{w}_{n}") for n in SHOWN for w, f in (("min", F.min), ("max", F.max))))


def answers(placed: DataFrame, bounds: DataFrame, reach: dict[str, int] = REACH) -> DataFrame:
    """For each occupied cell z, with its first and last file: files_touched and files_matching of its rows' query.

    Coordinates without reach make the groups; the box goes reach to either side of the others.
    """
    exact, wide = [n for n in SHOWN if not reach[n]], [n for n in SHOWN if reach[n]]
    top = (1 << BITS) - 1
    cells = placed.groupBy("z").agg(F.min("file").alias("first_file"), F.max("file").alias("last_file"))
    cells = cells.withColumns({f"c_{n}": coordinate(F.col("z"), ORDER.index(n)) for n in ORDER})
    alike = bounds.groupBy(*(c for c in bounds.columns if c != "file")).agg(F.count(F.lit(1)).alias("n"))
    for n in exact:
        alike = alike.withColumn(f"c_{n}", F.explode(F.sequence(f"min_{n}", f"max_{n}")))
    edges = [f"{w}_{n}" for n in wide for w in ("min", "max")]
    keys = [f"c_{n}" for n in exact]
    alike = alike.groupBy(*keys, *edges).agg(F.sum("n").alias("n"))

    def answer(cells: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("z")
        box = {n: (np.maximum(cells[f"c_{n}"].to_numpy() - reach[n], 0), np.minimum(cells[f"c_{n}"].to_numpy() + reach[n], top)) for n in ORDER}
        met = np.ones((len(cells), len(files)), bool)
        for n in wide:
            met &= (files[f"min_{n}"].to_numpy() <= box[n][1][:, None]) & (files[f"max_{n}"].to_numpy() >= box[n][0][:, None])
        z, first, last = (cells[c].to_numpy(np.int64) for c in ("z", "first_file", "last_file"))
        matching, seen = np.zeros(len(z), np.int64), np.full(len(z), -1, np.int64)
        for query, a, b in ranges(*(interleaved([box[n][side] for n in ORDER]) for side in (0, 1))):
            i, j = np.searchsorted(z, a), np.searchsorted(z, b, "right")
            some = i < j
            query, i, j = query[some], i[some], j[some]
            # a range's occupied cells follow one another, and so do their files; one range's last file may be the next one's first
            matching[query] += last[j - 1] - np.maximum(first[i], seen[query] + 1) + 1
            seen[query] = last[j - 1]
        return pd.DataFrame({"z": z, "first_file": first, "last_file": last, "files_touched": met @ files["n"].to_numpy(np.int64), "files_matching": matching})

    schema = "z long, first_file long, last_file long, files_touched long, files_matching long"
    return cells.groupBy(*keys).cogroup(alike.groupBy(*keys)).applyInPandas(answer, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    docs = S.documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    placed = S.cut(layout(docs, keep=["doc_id"]), "placed")
    bounds = S.cut(file_bounds(placed), "bounds")
    found = answers(placed, bounds).select("z", "files_touched", "files_matching", F.explode(F.sequence("first_file", "last_file")).alias("file"))
    shown = F.concat_ws(",", *(F.col(f"{w}_{n}").cast("string") for n in SHOWN for w in ("min", "max")))
    known = found.join(bounds.select("file", shown.alias("file_bounds")), "file")
    return placed.join(known, ["file", "z"]).select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


# ---------------------------------------------------------------- a stored layout


def save(placed: DataFrame, path: str) -> None:
    """A layout as Parquet files in the order of its places, so that their statistics of z tell which a box may skip."""
    placed.repartitionByRange("position").sortWithinPartitions("position").write.parquet(path)


def select(table: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows of a saved layout in a box (coordinate name: least and greatest): its ranges of codes go to the scan as filters."""
    top = (1 << BITS) - 1
    low, high = (interleaved([np.array([box.get(n, (0, top))[side]]) for n in ORDER]) for side in (0, 1))
    merged: list[list[int]] = []
    for _, a, b in ranges(low, high):
        if merged and merged[-1][1] + 1 == a[0]:
            merged[-1][1] = int(b[0])
        else:
            merged.append([int(a[0]), int(b[0])])
    own = F.lit(False)
    for a, b in merged:
        own = own | F.col("z").between(a, b)
    outer = F.col("z").between(int(low[0]), int(high[0]))
    return table.where(outer & own if len(merged) <= 200 else outer & exact_box(box))


def exact_box(box: dict[str, tuple[int, int]]) -> Column:
    out = F.lit(True)
    for n, (a, b) in box.items():
        out = out & F.col(f"c_{n}").between(a, b)
    return out


#: Ranks by windows; every occupied cell's query compared with every file and every cell, one by one.
SQL = f"""
WITH v AS (SELECT doc_id, encode(source) AS source, encode(lang) AS lang, coalesce(octet_length(encode(text)), -1) AS length, {S.crc_sql("doc_id::VARCHAR")} % 365 AS date FROM documents),
r AS (SELECT doc_id, 16 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () AS s, 16 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () AS l,
             16 * (rank() OVER (ORDER BY length) - 1) // count(*) OVER () AS n, 16 * (rank() OVER (ORDER BY date NULLS FIRST) - 1) // count(*) OVER () AS d FROM v),
c AS (SELECT *, {" + ".join(f"((({x} >> {b}) & 1) << {4 * b + 3 - k})" for k, x in enumerate("nsdl") for b in range(4))} AS z FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM c),
f AS (SELECT *, position // 500 AS file FROM p),
b AS (SELECT file, {", ".join(f"{w}({x}) AS {w}_{x}" for x in "slnd" for w in ("min", "max"))} FROM f GROUP BY file),
cells AS (SELECT DISTINCT z, s, l, n, d FROM f),
touched AS (SELECT z, count(*) AS files_touched FROM cells JOIN b ON s BETWEEN min_s AND max_s AND l BETWEEN min_l AND max_l AND min_n <= n + 2 AND max_n >= n - 2 AND min_d <= d + 2 AND max_d >= d - 2 GROUP BY z),
matching AS (SELECT q.z, count(DISTINCT f.file) AS files_matching FROM cells AS q JOIN f ON f.s = q.s AND f.l = q.l AND abs(f.n - q.n) <= 2 AND abs(f.d - q.d) <= 2 GROUP BY q.z)
SELECT doc_id, z::BIGINT AS z, position::BIGINT AS position, file::BIGINT AS file, files_touched, files_matching,
       concat_ws(',', min_s, max_s, min_l, max_l, min_n, max_n, min_d, max_d) AS file_bounds
FROM f JOIN b USING (file) JOIN touched USING (z) JOIN matching USING (z)
"""
