"""What the operators of this subpackage share: scratch tables, text chunks, hashing.

Texts reach Python in Arrow batches and are cut into chunks of about a megabyte
(one text is never cut), so the memory of a task is bounded by a chunk or by its
longest text. Words are ``[^\\x20\\x09-\\x0D]+`` everywhere.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.inputs import spread
from ..sources.scratch import Scratch, shared_dir  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with as many underscores as make it none of the columns of `docs` (whatever their case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as a reference, also if it has dots."""
    return "`" + name.replace("`", "``") + "`"


def join_split(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows with the columns of `groups`, an aggregate with one row for each value of the long column `key`.

    An aggregate is dealt out by its key already, and a join on it would have an exchange on one
    side only, which adaptive execution can't split at hot keys. Here the aggregate goes by the
    key's complement, so both sides have an exchange of their own.
    """
    others = [c for c in groups.columns if c != key]
    dealt = groups.select(F.bitwise_not(key).alias("_complement"), *others)
    return rows.join(dealt.hint("merge"), F.col(key) == F.bitwise_not("_complement")).drop("_complement")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(os.fspath(to))
    _shipped.add(sc.applicationId)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Word hashes of one seed: a random 64-bit value for each byte at each of the first places, and what tells longer words' blocks apart."""

    WIDTH = 16

    def __init__(self, seed: int):
        cells = np.arange(self.WIDTH * 256, dtype=np.uint64) + np.uint64(seed << 32)
        self.values = mix(mix(cells ^ _MIX_A) ^ np.uint64(seed)).reshape(-1)
        self.block_key = mix(np.array([seed + 77], dtype=np.uint64))[0]


_hashers: dict[int, Hasher] = {}

#: Kinds of bytes; a token is a longest run of one kind other than 0.
WORDS = np.ones(256, dtype=np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0
LETTERS, DIGITS, SIGNS = 1, 2, 3
TOKENS = np.full(256, SIGNS, dtype=np.uint8)
TOKENS[WORDS == 0] = 0
TOKENS[0x30:0x3A] = DIGITS
TOKENS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTERS


def hasher(seed: int) -> Hasher:
    if seed not in _hashers:
        _hashers[seed] = Hasher(seed)
    return _hashers[seed]


class Chunk:
    """Some rows of a batch with their texts' UTF-8 bytes and tokens (words, unless `kinds` says otherwise).

    rows lo..hi of the batch; data: their bytes; ends: n+1 byte offsets of the texts;
    start, stop: byte offsets of each token; first: n+1 token offsets of the texts.
    """

    def __init__(self, lo: int, hi: int, data: np.ndarray, ends: np.ndarray, kinds: np.ndarray = WORDS):
        self.lo, self.hi, self.data, self.ends = lo, hi, data, ends
        kind = kinds[data]
        inside = kind > 0
        change = np.ones(len(data) + 1, dtype=bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[ends] = True
        self.start = np.flatnonzero(change[:-1] & inside)
        self.stop = np.flatnonzero(change[1:] & inside) + 1
        self.first = np.searchsorted(self.start, ends)
        self.inside = inside
        self._places: np.ndarray | None = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each token, of its ASCII lower-case form if `lower`."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        h = hasher(seed)
        if self._places is None:
            # place of each byte in its token
            gaps = np.ones(len(self.data), dtype=np.int32)
            gaps[self.start[1:]] = 1 - np.diff(self.start)
            gaps[: self.start[0] + 1] = 0
            self._places = np.cumsum(gaps, dtype=np.int32)
            self._places[~self.inside] = 0
        place, data = self._places, self.data
        if lower:
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
        length = self.stop - self.start
        terms = h.values[((place & (h.WIDTH - 1)) << 8) + data]
        terms *= self.inside
        if int(length.max()) > h.WIDTH:
            # later blocks of a word are mixed with their number before they are added
            opens = np.flatnonzero(self.inside & (place & (h.WIDTH - 1) == 0))
            number = (place[opens] // h.WIDTH).astype(np.uint64)
            sums = np.add.reduceat(terms, opens)
            sums[number > 0] = mix(mix(sums[number > 0]) ^ mix(number[number > 0] + h.block_key))
            whole = np.add.reduceat(sums, np.searchsorted(opens, self.start))
        else:
            whole = np.add.reduceat(terms, self.start)
        return mix(whole + length.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]].tobytes()


def chunks(texts: pa.Array, size: int = CHUNK_BYTES, kinds: np.ndarray = WORDS) -> Iterator[Chunk]:
    """The texts of an Arrow array (null: empty) in chunks of about `size` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], kinds)
        lo = hi


def sequence_hash(hashes: np.ndarray, first: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each text's word sequence."""
    n = np.diff(first)
    place = np.arange(len(hashes), dtype=np.int64) - np.repeat(first[:-1], n)
    terms = mix(hashes ^ mix(place.astype(np.uint64) + np.uint64(seed << 32)))
    total = np.zeros(len(n) + 1, dtype=np.uint64)
    sums = np.concatenate([total[:1], np.cumsum(terms, dtype=np.uint64)])
    return mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64) * _GOLDEN)


def window_sums(values: np.ndarray, width: int, seed: int = 3) -> np.ndarray:
    """Hash of each `width` consecutive values; entry i covers values i..i+width-1."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = mix(np.arange(width, dtype=np.uint64) + np.uint64(seed * 7919)) | np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out += values[j : j + n] * factors[j]
    return mix(out)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list array with counts[i] values in row i."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
