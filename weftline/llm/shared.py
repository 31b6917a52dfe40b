"""What the operators of this subpackage share: the shared folder, Arrow blocks, tokenization by distinct pieces."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; a longer text makes a block of its own.
BLOCK_BYTES = 6 << 20
#: Bytes that a Python worker's encoded pieces may take, about; beyond it the memo starts anew. Longer pieces are not kept.
MEMO_BYTES, MEMO_CHARACTERS = 32 << 20, 64


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root else "file://" + os.path.abspath(root)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/weftline-{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends in files that outlive executors."""
    path = path or scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of df that are not named, in any case, like one of names."""
    own = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in own]


def fields(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The schema of those columns of df, and of more (a DDL string) after them."""
    return T.StructType([*(df.schema[c] for c in names), *T.StructType.fromDDL(more).fields])


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id as text, the fold key."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text of ASCII characters."""
    step = "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), {step}))"


def release() -> None:
    """Give freed memory back to the system: workers are used again by later stages, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(maxsize=1)
def _trim():
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about limit bytes of the column each, one row at least."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
    release()


def apart(taken: list[str], *names: str) -> list[str]:
    """The names, each made longer until it is none of those taken (in any case): columns of an operator's own beside a caller's."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] to before starts[i] + counts[i] one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + counts[i]] one after another."""
    return flat[runs(starts, counts)] if counts.any() else flat[:0]


def excl(counts: np.ndarray) -> np.ndarray:
    """Exclusive running sum."""
    return np.cumsum(counts) - counts


#: A boundary between pieces that byte-level pre-tokenizers never cross: one space between two other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Memo:
    """Encoded pieces by their strings in two generations: when the newer is full the older goes, less what was met since."""

    def __init__(self):
        self.new, self.old, self.held = {}, {}, 0

    def all(self, pieces: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of distinct pieces; those not kept are encoded together."""
        new = self.new
        out = list(map(new.get, pieces))
        missing = [k for k, v in enumerate(out) if v is None]
        again = list(map(self.old.get, [pieces[k] for k in missing]))
        coded, held = iter(encode([pieces[k] for k, v in zip(missing, again, strict=True) if v is None])), self.held
        for k, v in zip(missing, again, strict=True):
            piece = pieces[k]
            out[k] = v = next(coded) if v is None else v
            if len(piece) <= MEMO_CHARACTERS:
                new[piece] = v
                held += 220 + len(piece) + len(v)  # with the room of a dictionary's entry
        self.held = held
        if held > MEMO_BYTES // 2:
            self.new, self.old, self.held = {}, new, 0
        return out


def joined(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids one after another, and the number of each."""
    return np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4


class PieceEncoder:
    """Encodes whole texts by their distinct pieces.

    known takes distinct strings and returns their ids one after another with the number of each. With lead, a piece is a
    chunk together with the one space before it (byte-level pre-tokenizers); without, white space only separates pieces.
    Since no pre-token crosses a piece's edge, the ids of a text are those of its pieces one after another.
    """

    def __init__(self, known: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], lead: bool):
        self.known, self.lead = known, lead

    @classmethod
    def of(cls, encode: Callable[[list[str]], list[bytes]]) -> PieceEncoder:
        """By a function that packs the ids of distinct strings with the space before them; what it gave is kept."""
        memo = Memo()
        return cls(lambda pieces: joined(memo.all(pieces, encode)), lead=True)

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Per text its number of pieces, for every piece the place of its string, and the strings."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        strings = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # no scalar a string
        counts = np.diff(offsets)
        if not self.lead:
            return counts, index, strings
        # only a text's first piece has no space before it: even places are strings with one, odd ones without
        index *= 2
        index[offsets[:-1] - offsets[0]] += 1
        used = np.zeros(2 * len(strings), bool)
        used[index] = True
        places = np.flatnonzero(used)
        index = (np.cumsum(used) - 1)[index]
        return counts, index, [strings[k >> 1] if k & 1 else " " + strings[k >> 1] for k in places.tolist()]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each. Nulls count as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, r"  | [\pZ\s\x0b\x1c-\x1f\x{85}]|[\pZ\s\x0b\x1c-\x1f\x{85}] | $|^ ")
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._gather(*self._units(texts))
        plain = np.flatnonzero(~odd)
        order = np.concatenate([plain, np.flatnonzero(odd)])
        whole = [_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        counts, index, strings = self._units(texts.take(pa.array(plain))) if len(plain) else (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        more: dict[str, int] = {}
        index = np.concatenate([index, np.fromiter((len(strings) + more.setdefault(" " * (k > 0) + s, len(more)) for t in whole for k, s in enumerate(t)), np.int64, sum(map(len, whole)))])
        ids, n = self._gather(np.concatenate([counts, [len(t) for t in whole]]).astype(np.int64), index, [*strings, *more])
        back = np.argsort(order)
        return ragged(ids, excl(n)[back], n[back]), n[back]

    def _gather(self, counts: np.ndarray, index: np.ndarray, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = self.known(strings)
        each = sizes[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return ragged(flat, excl(sizes)[index], each), ends[edge[1:]] - ends[edge[:-1]]


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def shown_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes and ids of a byte-level vocabulary in the tokenizers library's file format, and its special tokens' ids."""
    import json

    with open(path, encoding="utf-8") as src:
        made = json.load(src)
    byte_of = {c: b for b, c in enumerate(shown_bytes())}
    special = {x["content"]: x["id"] for x in made["added_tokens"]}
    return {bytes(map(byte_of.__getitem__, token)): k for token, k in made["model"]["vocab"].items() if token not in special}, special


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> PieceEncoder:
    """Byte-level BPE by the tiktoken library: of a rank file without special tokens, of a vocabulary (.json) with its own.

    In both kinds of file a token's id is its rank among the merges.
    """
    import public_tokenizers
    import tiktoken

    ranks, special = read_vocabulary(path) if path.endswith(".json") else (read_ranks(path), {})
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    if not special:
        return PieceEncoder.of(lambda pieces: [pack(own.encode_ordinary(p)) for p in pieces])
    marks = re.compile("(" + "|".join(map(re.escape, special)) + ")")

    def one(piece: str) -> bytes:
        parts = marks.split(piece) if "<|" in piece or marks.search(piece) else [piece]
        return pack([i for part in parts for i in ([special[part]] if part in special else own.encode_ordinary(part))])

    return PieceEncoder.of(lambda pieces: list(map(one, pieces)))


class WordEncoder(PieceEncoder):
    """A word-end vocabulary by the tokenizers library, on distinct words.

    White space only separates words here and ASCII capitals count as small letters, so a space goes between a word and the
    punctuation that ends it, which no pre-token holds together. A word of small Latin letters is a pre-token as it is, so
    the library's model alone encodes its bytes (in the letters that stand for them); others go through the library's
    normalizer and pre-tokenizer, and so do whole texts with special tokens, in any spelling.
    """

    #: A letter or number before and after normalization, and punctuation up to a space or the end.
    CLOSING = r"([a-z0-9ßà-öø-ÿ])([!-/:-@\[-`{-~]+)( |$)"
    #: Words that the normalizer leaves as they are and that are one pre-token.
    PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch

    def __init__(self, path: str):
        self.own, self.memo = _library(path), Memo()
        super().__init__(lambda words: joined(self.memo.all(words, self.encode)), lead=False)
        special = [re.escape(x.content) for x in self.own.get_added_tokens_decoder().values()]
        self.special = f"(?i){'|'.join(special)}" if special else "$^"
        self.letters = {code: "".join(shown_bytes()[b] for b in chr(code).encode()) for code in range(0xDF, 0x100)}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        special = pc.match_substring_regex(texts, self.special)
        if not pc.any(special).as_py():
            return self._words(texts)
        odd = special.to_numpy(zero_copy_only=False)
        ids, n = self._words(texts.filter(pc.invert(special)))
        whole = [e.ids for e in self.own.encode_batch_fast(texts.filter(special).to_pylist(), add_special_tokens=False)]
        ids, n = np.concatenate([ids, *(np.array(x, np.uint32) for x in whole)]), np.concatenate([n, [len(x) for x in whole]]).astype(np.int64)
        back = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
        return ragged(ids, excl(n)[back], n[back]), n[back]

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        small = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        return self._gather(*self._units(pc.replace_substring_regex(small, self.CLOSING, r"\1 \2\3")))

    def encode(self, words: list[str]) -> list[bytes]:
        tokenize, plain, table = self.own.model.tokenize, self.PLAIN, self.letters
        out = [pack([t.id for t in tokenize(w if w.isascii() else w.translate(table))]) if plain(w) else None for w in words]
        rest = [k for k, v in enumerate(out) if v is None]
        for k, e in zip(rest, self.own.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = pack(e.ids)
        return out


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary in the tokenizers library's file format."""
    return max(_library(path).get_vocab().values()) + 1


@lru_cache(maxsize=2)
def library_encoder(path: str, lead: bool) -> PieceEncoder:
    """The tokenizers library on distinct pieces, with a leading space (byte-level) or on words (with word ends)."""
    if not lead:
        return WordEncoder(path)
    own = _library(path)
    return PieceEncoder.of(lambda pieces: [pack(e.ids) for e in own.encode_batch_fast(pieces, add_special_tokens=False)])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
