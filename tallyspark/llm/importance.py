"""Importance resampling of documents towards a target distribution.

A text's features are its runs of 1 to `longest` words (ASCII-lower-cased, words of letters,
digits and other than ASCII characters), joined by one space, each in the bucket of its
CRC-32 modulo `buckets`. What a bucket is worth (its gain) is the log of how much likelier it
is in the target than in the documents; a document's weight is the floored mean of its
features' gains. Gumbel noise on top, drawn from a seed and the id alone, makes the highest
scores a weighted draw without replacement.

The CRCs are not computed text by text. A CRC is linear: each byte adds (XOR) what it is worth
at its distance from the end, and the length adds a constant. Both are tables, so the CRCs of
all spans of a chunk are one gather and one `bitwise_xor.reduceat`. Spans longer than the
tables fold block by block: what is there so far moves on by a block of zeros.

Each side's counts are added up in the tasks and then by bucket, so at most `buckets` rows a
task are shuffled and `buckets` integers are sent back. The draw's ranks are dealt out
(operators/ranking.py). Texts are read twice and never shuffled.

Null texts have no features; without features the weight is 0. A null id is drawn as the empty
text. Rows with the same id are documents of their own with the same noise; ties of score and
id go by n_features and weight, and rows that agree in those, too, are interchangeable.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import Chunk, Scratch, chunks, free_name, quoted, ship

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
MIN_WORDS, DRAWN_PERCENT = 20, 10
SCALE = 1000.0
#: Longest span that the tables cover at once.
WIDTH = 64

_POLYNOMIAL = 0xEDB88320
_FULL = np.uint32(0xFFFFFFFF)

#: Bytes of words: digits, letters and all of other than ASCII characters.
FEATURE_BYTES = np.zeros(256, dtype=np.uint8)
FEATURE_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


class SpanCrc:
    """CRC-32 of spans of bytes from tables of `width` distances."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        bits = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            bits = np.where(bits & 1, (bits >> 1) ^ np.uint32(_POLYNOMIAL), bits >> 1)
        self.step = bits  # what a byte before the last one is worth after one zero byte
        # by_place[d, b]: byte b followed by d bytes
        self.by_place = np.empty((width, 256), dtype=np.uint32)
        self.by_place[0] = bits
        for d in range(1, width):
            self.by_place[d] = self._zero(self.by_place[d - 1])
        # start[n]: the initial register after n bytes
        self.start = np.empty(width + 1, dtype=np.uint32)
        self.start[0] = _FULL
        for n in range(width):
            self.start[n + 1] = self._zero(self.start[n : n + 1])[0]
        # over[k, b]: byte k of a register after `width` zero bytes
        over = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        for _ in range(width):
            over = self._zero(over)
        self.over = over

    def _zero(self, register: np.ndarray) -> np.ndarray:
        return (register >> np.uint32(8)) ^ self.step[register & np.uint32(255)]

    def _fold(self, register: np.ndarray) -> np.ndarray:
        out = np.zeros_like(register)
        for k in range(4):
            out ^= self.over[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def _linear(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """XOR of what the bytes of spans of 1 to `width` bytes are worth."""
        n = stop - start
        ends = np.cumsum(n)
        opens = ends - n
        at = np.arange(int(ends[-1])) + np.repeat(start - opens, n)
        before_end = np.repeat(stop - 1, n) - at
        return np.bitwise_xor.reduceat(self.by_place.ravel()[(before_end << 8) + data[at]], opens)

    def __call__(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """CRCs of the spans data[start:stop], none of them empty."""
        out = np.empty(len(start), dtype=np.uint32)
        n = stop - start
        short = np.flatnonzero(n <= self.width)
        if len(short):
            out[short] = self._linear(data, start[short], stop[short]) ^ self.start[n[short]]
        long = np.flatnonzero(n > self.width)
        if len(long):
            # the first block takes the odd bytes, all others are full
            head = (n[long] - 1) % self.width + 1
            at = start[long] + head
            register = self._linear(data, start[long], at) ^ self.start[head]
            live = np.arange(len(long))
            while len(live):
                register[live] = self._fold(register[live]) ^ self._linear(data, at[live], at[live] + self.width)
                at[live] += self.width
                live = live[at[live] < stop[long[live]]]
            out[long] = register
        return out ^ _FULL


_crc: dict[int, SpanCrc] = {}


def span_crc() -> SpanCrc:
    if WIDTH not in _crc:
        _crc[WIDTH] = SpanCrc()
    return _crc[WIDTH]


def features(c: Chunk, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of the features of a chunk's texts, and the text of each."""
    data = c.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    owner = np.repeat(np.arange(c.hi - c.lo), c.n_words)
    start, stop = c.start, c.stop
    if longest > 1 and len(start):
        # words one after the other with a space between, so that a run of words is a span
        lengths = stop - start
        low = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
        shift = np.repeat(start - low, lengths)
        to = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)
        joined[to] = data[to + shift]
        data, start, stop = joined, low, low + lengths
    crcs, owners = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
    for n in range(1, longest + 1):
        first = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, dtype=np.int64)
        if len(first):
            crcs.append(span_crc()(data, start[first], stop[first + n - 1]))
            owners.append(owner[first])
    return np.concatenate(crcs), np.concatenate(owners)


def count_batches(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Features by bucket over all texts of a partition."""
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for c in chunks(batch.column(0), kinds=FEATURE_BYTES):
            crcs, _ = features(c, longest)
            total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of the column `text` by bucket: `buckets` integers, whatever the texts."""
    parts = texts.select(F.col("text").cast("string")).mapInArrow(lambda it: count_batches(it, buckets, longest), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(SCALE * math.log(float((b + 1) * (s + n)) / float((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weight_batches(batches: Iterator[pa.RecordBatch], gains: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """The id of each row with its numbers of words and features and its weight."""
    for batch in batches:
        for c in chunks(batch.column(1), kinds=FEATURE_BYTES):
            docs = c.hi - c.lo
            crcs, owner = features(c, longest)
            n = np.bincount(owner, minlength=docs)
            # integer sums, so the mean's floor is exact
            total = np.zeros(docs, dtype=np.int64)
            np.add.at(total, owner, gains[crcs % np.uint32(len(gains))])
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, docs), *(pa.array(x.astype(np.int64)) for x in (c.n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(1000 * a Gumbel number) that seed and id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score. docs: doc_id and text; target: text."""
    ship(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    weights = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: weight_batches(it, gains, longest), "doc_id long, n_words long, n_features long, weight long")
    return weights.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, **how: int) -> DataFrame:
    """importance_scores with `rank`: 1 for the highest score of the drawn documents, null for all others.

    Of the N documents with at least `min_words` words, floor(percent * N / 100) are drawn.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    scored = scratch.keep(importance_scores(docs, target, **how), "scored")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    placed = ranked(fit, order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of the documents that are drawn, with all their columns, in no order. A null or repeated id stands for all rows that have it."""
    own, key = free_name(docs, "drawn"), quoted("doc_id")
    ids = resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(ids, docs[key].eqNullSafe(ids[quoted(own)]), "left_semi")


#: The registered query on the tables `documents` and `benchmark`. A CRC is worked out byte by byte for each distinct word.
ORACLE_SQL = r"""
WITH bytes AS (
    SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x)) AS step
), texts AS (
    SELECT 1 AS side, row_number() OVER () AS row_no, doc_id, text FROM documents UNION ALL SELECT 2, 0, NULL, text FROM benchmark
), split AS (
    SELECT side, row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), told AS (
    SELECT side, row_no, unnest(words) AS word FROM split
), words AS (
    SELECT DISTINCT word, hex(encode(word)) AS digits FROM told
), crcs AS (
    SELECT word, xor(list_reduce(list_transform(range(length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM words, bytes
), placed AS (
    SELECT side, row_no, bucket FROM told JOIN crcs USING (word)
), counts AS (
    SELECT bucket, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 2) AS t FROM placed GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM counts
), sums AS (
    SELECT row_no, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 1 GROUP BY row_no
), scored AS (
    SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM split LEFT JOIN sums USING (row_no) WHERE side = 1
), ranks AS (
    SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id, n_features, weight) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM ranks
"""
