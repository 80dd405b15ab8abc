"""Removal of long repeated passages by recompression.

A window is `width` consecutive words of one document; every word that lies in a window
whose word sequence also starts anywhere else (same document included) is removed.

Recompression: words are named by hashes. A round names runs (a symbol that occurs
exactly twice in a row becomes one) and then pairs (a hash bit makes each symbol a left or
a right one, and each left-right pair becomes one symbol); later rounds name pairs only.
Names are hashes of what they stand for, so equal symbols have equal names in all
documents without any exchange, and whether symbols join depends on their neighbours
alone: inside two equal passages the symbols are the same but for a margin at both ends.
The rounds stop after one of runs and two of pairs, and they run inside the tasks: hash names
need no exchange of a dictionary between rounds, and longer symbols would need a longer
margin (it doubles with each round), which a window of 35 words doesn't have. So symbols
reveal where equal passages may be (the anchors), and the repeats themselves are told by
hashes of the words around the anchors, not by one symbol that spans them.
With the rounds used here a symbol spans at most LENGTH = 8 words and the margin is
MARGIN = 8 words: whether a word begins a run depends on 2 words to either side, a pair
of the first round on one more symbol of at most 2 words and one of the second round on
one of at most 4. A symbol that begins after the margin and at least MARGIN + 1 words
before the window's end is the same in all copies of the window. So every window of at
least 2 * MARGIN + LENGTH words has an anchor: of the symbols that begin there the one
with the smallest hash.

1. Each anchor's place serves a few consecutive windows (at most width - 2 * MARGIN), which
   all hold the MARGIN words to both sides of it: the symbol and these words are the
   place's name. One row per place goes to its name, with a 64-bit hash of the whole span of
   words that its windows cover, the document, and where the windows begin. Places with equal names
   and spans repeat in all their windows, which settles long repeats a place at a time.
   Misra-Gries summaries of the tasks find the names and the (name, span) pairs of more than
   2 / (HEAVY + 1) of all places; at most HEAVY + 1 of each are broadcast. Places of a frequent
   pair repeat for certain and go to any task; one example of the pair stands for it in step 2.
   Other places of a frequent name are dealt by name and span, all others by name, so no task
   gathers what is frequent.
2. A name with a single span can't hide further repeats. For other names the windows of
   single places, and of one place for each repeated span, are verified one by one: pairs
   of 64-bit hashes of their words, of two seeds, are counted over all documents.
3. Repeated windows go back to their documents, which drop the words they cover.

A window's words are never sent; a document's marks are bounded by its own length.
Documents are known by id and a 64-bit hash of the text, so ids may repeat. Null and
empty texts have no words and no windows. Repeated rows are copies of each other, also
when their ids are equal. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Chunk, Scratch, as_long, chunks, lists, mix, ship, text_of

WIDTH = 35
LENGTH = 8
MARGIN = 8
HEAVY = 1024

_RUN = np.uint64(0x52554E)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def name_runs(names: np.ndarray, begin: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols that occur exactly twice in a row become one; longer runs stay as they are."""
    n = len(names)
    if n < 2:
        return names, begin, doc
    same = np.zeros(n + 1, dtype=bool)  # same[i]: symbols i-1 and i are equal neighbours
    same[1:n] = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
    second = same[:n].copy()
    second &= ~same[1:]  # the run ends here
    second[1:] &= ~same[: n - 1]  # and began one before
    first = np.zeros(n, dtype=bool)
    first[:-1] = second[1:]
    out = np.where(first, mix(names ^ _RUN), names)
    return out[~second], begin[~second], doc[~second]


def name_pairs(names: np.ndarray, begin: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each neighbouring left and right symbol become one."""
    n = len(names)
    if n < 2:
        return names, begin, doc
    left = (mix(names + np.uint64(level + 1)) & np.uint64(1)).astype(bool)
    second = np.zeros(n, dtype=bool)
    second[1:] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
    first = np.zeros(n, dtype=bool)
    first[:-1] = second[1:]
    out = names.copy()
    at = np.flatnonzero(first)
    out[at] = mix(names[at] * _PAIR + mix(names[at + 1] + np.uint64(level << 8)))
    return out[~second], begin[~second], doc[~second]


def symbols(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols after all rounds, and the word positions at which they begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    state = name_runs(words, np.arange(len(words)), doc)
    for level in (0, 1):
        state = name_pairs(*state, level)
    return state[0], state[1]


def window_anchors(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows (word positions), and the position at which each one's anchor begins; also names by position."""
    names, begin = symbols(words, first)
    n = len(words)
    key = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    key[begin] = mix(names) >> np.uint64(1)
    # the safe part: symbols that begin here are the same in all copies of the window
    span = width - 2 * MARGIN
    # sliding minimum over `span` positions by doubling; of equal keys the first position
    best, reach = key, 1
    place = np.arange(n)
    while reach < span:
        step = min(reach, span - reach)
        other, at = best[step:], place[step:]
        new, where = best.copy(), place.copy()
        less = other < best[: n - step]
        new[: n - step][less] = other[less]
        where[: n - step][less] = at[less]
        best, place = new, where
        reach += step
    count = np.maximum(np.diff(first) - width + 1, 0)
    starts = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    full = np.zeros(n, dtype=np.uint64)
    full[begin] = names
    return starts, np.column_stack([place[starts + MARGIN].astype(np.int64), full[place[starts + MARGIN]].view(np.int64)]) if len(starts) else np.zeros((0, 2), dtype=np.int64)


def span_hashes(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the words low..high-1."""
    # a factor of its own for each place, so that no sequences collide by construction
    longest = int((high - low).max(initial=0))
    factors = mix(np.arange(longest, dtype=np.uint64) ^ _PAIR) | np.uint64(1)
    mixed, out = mix(words), np.zeros(len(low), dtype=np.uint64)
    for j in range(longest):
        live = np.flatnonzero(low + j < high)
        out[live] += mixed[low[live] + j] * factors[j]
    return mix(out + mix((high - low).astype(np.uint64)))


def place_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per document: id, hash of the text, and of each anchor's place the name, the span's hash and start * 32 + number of windows."""
    for batch in batches:
        for c in chunks(batch.column("text")):
            h = c.hashes()
            starts, anchors = window_anchors(h, c.first, width)
            docs = c.hi - c.lo
            # windows over the same place follow each other, and their anchors move on, so a place comes once
            at = np.flatnonzero(np.concatenate([[True], anchors[1:, 0] != anchors[:-1, 0]])) if len(starts) else np.zeros(0, dtype=np.int64)
            windows = np.diff(np.append(at, len(starts)))
            low = starts[at]
            # all windows of a place hold the words within the margin around its symbol: they name it, too
            around = anchors[at, 0]
            name = mix(anchors[at, 1].view(np.uint64) ^ span_hashes(h, around - MARGIN, around + MARGIN + 1))
            span = mix(span_hashes(h, low, low + windows - 1 + width) ^ mix((around - low).astype(np.uint64)))
            owner = np.searchsorted(c.first, low, side="right") - 1
            counts = np.bincount(owner, minlength=docs)
            rows = [lists(x, counts, pa.int64()) for x in (as_long(name), as_long(span), (low - c.first[:-1][owner]) * 32 + windows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(c.lo, docs) for n in ("doc_id", "text_hash")), *rows], ["doc_id", "text_hash", "name", "span", "place"])


class Frequent:
    """A Misra-Gries summary of keys, each with what `row_of` gave for one of its occurrences."""

    def __init__(self, counters: int):
        self.counters = counters
        self.keys, self.counts, self.rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), []

    def add(self, keys: np.ndarray, row_of: Callable[[int], tuple]) -> None:
        found, at, n = np.unique(keys, return_index=True, return_counts=True)
        held = len(self.keys)
        keys, first, which = np.unique(np.concatenate([self.keys, found]), return_index=True, return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate([self.counts, n]), minlength=len(keys)).astype(np.int64)
        if len(keys) > self.counters:
            # take away the (counters + 1)-th largest count from all, as so many single decrements would
            counts -= np.partition(counts, len(counts) - 1 - self.counters)[len(counts) - 1 - self.counters]
            left = counts > 0
            keys, first, counts = keys[left], first[left], counts[left]
        self.rows = [self.rows[i] if i < held else row_of(int(at[i - held])) for i in first.tolist()]
        self.keys, self.counts = keys, counts


def frequent_batches(batches: Iterator[pa.RecordBatch], width: int, counters: int) -> Iterator[pa.RecordBatch]:
    """A task's frequent names (name, null span, seen) and pairs (name, span, seen, and the place of one), and the number of its places with a null name."""
    names, pairs, total, kind = Frequent(counters), Frequent(counters), 0, pa.int64()
    for batch in place_batches(batches, width):
        docs, hashes, kind = batch.column("doc_id"), batch.column("text_hash"), batch.schema.field("doc_id").type
        owner = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("name").value_lengths()))
        name, span, place = (batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("name", "span", "place"))
        total += len(name)
        names.add(name.view(np.uint64), lambda i: (int(name[i]), None, None, None, None))
        pairs.add(mix(name.view(np.uint64) ^ mix(span.view(np.uint64))), lambda i: (int(name[i]), int(span[i]), docs[int(owner[i])].as_py(), hashes[int(owner[i])].as_py(), int(place[i])))
    if not total:
        return
    rows = [*names.rows, *pairs.rows, (None, None, None, None, None)]
    columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), kind, pa.int64(), pa.int64()), strict=True)]
    seen = pa.array([*names.counts.tolist(), *pairs.counts.tolist(), total], pa.int64())
    yield pa.RecordBatch.from_arrays([*columns, seen], ["name", "span", "doc_id", "text_hash", "place", "seen"])


def frequent_places(base: DataFrame, scratch: Scratch, width: int, counters: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Frequent names (name), and frequent pairs (name, span, example): every one of more than 2 / (counters + 1) of all places, at most counters + 1 of each and the pairs' names."""
    columns = f"name long, span long, doc_id {kind}, text_hash long, place long, seen long"
    found = base.mapInArrow(lambda it: frequent_batches(it, width, counters), columns)
    seen = scratch.keep(found.groupBy("name", "span").agg(F.sum("seen").alias("seen"), F.min(F.struct("doc_id", "text_hash", "place")).alias("example")), "seen")
    total = seen.where("name is null").agg(F.sum("seen")).first()[0] or 0
    many = scratch.keep(seen.where(F.col("name").isNotNull() & (F.col("seen") >= max(2, total / (counters + 1)))), "frequent")
    return many.select("name").distinct(), many.where("span is not null").select("name", "span", "example")


def kept_sha(c: Chunk, i: int, gone: np.ndarray | None) -> str:
    """SHA-256 of the words of text i that are not gone, joined by spaces."""
    a, b = c.first[i], c.first[i + 1]
    keep = np.arange(a, b) if gone is None else np.flatnonzero(~gone) + a
    if not len(keep):
        return hashlib.sha256(b"").hexdigest()
    lengths = c.stop[keep] - c.start[keep]
    out = np.full(int(lengths.sum()) + len(keep) - 1, 0x20, dtype=np.uint8)
    to = np.cumsum(lengths + 1) - lengths - 1
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(to, lengths) + within] = c.data[np.repeat(c.start[keep], lengths) + within]
    return hashlib.sha256(out.tobytes()).hexdigest()


def window_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows of the places in `checked`: two hashes of the words, document, position; `single` if the place's span occurs once."""
    for batch in batches:
        for c in chunks(batch.column("text")):
            docs = c.hi - c.lo
            own = batch.column("checked").slice(c.lo, docs)
            packed = own.flatten().to_numpy(zero_copy_only=False)
            # packed: place * 2 + single
            owner = np.repeat(np.arange(docs), np.asarray(own.value_lengths().fill_null(0)))
            place, single = packed >> 1, packed & 1
            count = place & 31
            begin = c.first[:-1][owner] + (place >> 5)
            at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            h = c.hashes()
            h2 = c.hashes(1)
            a, b = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
            for j in range(width):
                a += h[at + j] * _factors(width, 1)[j]
                b += h2[at + j] * _factors(width, 2)[j]
            doc = np.repeat(owner, count)
            take = pa.array(doc)
            where = (at - c.first[:-1][doc]) * 2 + np.repeat(single, count)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(mix(a))), pa.array(as_long(mix(b))), *(batch.column(n).slice(c.lo, docs).take(take) for n in ("doc_id", "text_hash")), pa.array(where)], ["h1", "h2", "doc_id", "text_hash", "at"])


def _factors(width: int, seed: int) -> np.ndarray:
    return mix(np.arange(width, dtype=np.uint64) + np.uint64(seed * 104729)) | np.uint64(1)


def removal_batches(batches: Iterator[pa.RecordBatch], width: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Per document: id, words, how many go, the digest of the rest, and the rest if `texts`."""
    for batch in batches:
        for c in chunks(batch.column("text")):
            docs = c.hi - c.lo
            settled, found = (batch.column(n).slice(c.lo, docs) for n in ("settled", "found"))
            removed, shas, left = [], [], []
            for i in range(docs):
                n = int(c.n_words[i])
                edge = np.zeros(n + 1, dtype=np.int64)
                if settled[i].is_valid and len(settled[i]):
                    place = np.asarray(settled[i].values)
                    np.add.at(edge, place >> 5, 1)
                    np.add.at(edge, (place >> 5) + (place & 31) - 1 + width, -1)
                if found[i].is_valid and len(found[i]):
                    start = np.asarray(found[i].values)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                shas.append(kept_sha(c, i, gone))
                if texts:
                    left.append(b" ".join(c.word(j) for j in np.flatnonzero(~gone) + c.first[i]).decode("utf-8", "replace"))
            columns = [batch.column("doc_id").slice(c.lo, docs), pa.array(c.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                columns.append(pa.array(left, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, width: int = WIDTH, texts: bool = False, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with `texts` kept_text."""
    if width < 2 * MARGIN + LENGTH or width - 2 * MARGIN > 31:
        raise ValueError(f"windows must have {2 * MARGIN + LENGTH} to {2 * MARGIN + 31} words")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "substrings")
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    arrays = base.mapInArrow(lambda it: place_batches(it, width), f"doc_id {kind}, text_hash long, name array<long>, span array<long>, place array<long>")
    places = arrays.select("doc_id", "text_hash", F.explode(F.arrays_zip("name", "span", "place")).alias("x")).select("x.name", "x.span", "doc_id", "text_hash", "x.place")
    names, pairs = frequent_places(base, scratch, width, heavy, kind)
    known = places.join(F.broadcast(names.withColumn("heavy", F.lit(True))), "name", "left").join(F.broadcast(pairs), ["name", "span"], "left")
    # 0: of a rare name, 1: of a frequent name, 2: of a frequent pair, 3: its example
    here = F.struct("doc_id", "text_hash", "place")
    level = F.when(F.col("example").isNotNull(), F.when(here.eqNullSafe(F.col("example")), 3).otherwise(2)).when(F.col("heavy"), 1).otherwise(0)
    salt = F.when(F.col("level") > 1, F.xxhash64("doc_id", "text_hash", "place")).when(F.col("level") == 1, F.col("span")).otherwise(F.lit(0))
    dealt = known.select("name", "span", "doc_id", "text_hash", "place", level.cast("byte").alias("level")).withColumn("salt", salt)
    by_span = Window.partitionBy("name", "salt", "span")
    rows = dealt.repartition("name", "salt").sortWithinPartitions("name", "salt", "span", "doc_id", "place")
    rows = rows.select(
        "doc_id", "text_hash", "place", "level", F.count(F.lit(1)).over(by_span).alias("equal"),
        F.row_number().over(by_span.orderBy("doc_id", "place")).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("name", "salt")).alias("named"),
    )
    equal = F.when(F.col("level") > 1, F.lit(2)).otherwise(F.col("equal"))
    first = F.when(F.col("level") > 1, F.col("level") == 3).otherwise(F.col("nth") == 1)
    # frequent names may have several spans; if not, their examples are verified for nothing
    several = (F.col("level") > 0) | (F.col("named") > F.col("equal"))
    rows = rows.select("doc_id", "text_hash", "place", equal.alias("equal"), first.alias("first"), several.alias("several"))
    marked = rows.where("equal > 1 or several").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.when(F.col("equal") > 1, F.col("place"))).alias("settled"),
        F.collect_list(F.when(F.col("several") & F.col("first"), F.col("place") * 2 + (F.col("equal") == 1).cast("long"))).alias("checked"),
    )
    # a document's lists are bounded by its own words
    marked = scratch.keep(marked, "marked")
    scratch.drop("seen", "frequent")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["_id"]) & (a["text_hash"] == b["_hash"])
    ids = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    checked = marked.where(F.size("checked") > 0).select(*ids, "checked")
    keyed = base.repartition("doc_id", "text_hash")  # read by both joins
    windows = keyed.join(checked, same(keyed, checked)).select("doc_id", "text_hash", "text", "checked")
    # of rows that repeat id and text one is enough; their places are settled as copies of each other
    windows = windows.mapInArrow(lambda it: window_batches(it, width), f"h1 long, h2 long, doc_id {kind}, text_hash long, at long")
    again = windows.select("doc_id", "text_hash", "at", F.count(F.lit(1)).over(Window.partitionBy("h1", "h2")).alias("n"))
    found = again.where("n > 1 and at % 2 = 1").groupBy(*ids).agg(F.collect_list(F.expr("at div 2")).alias("found"))
    settled = marked.select(*ids, "settled").withColumnsRenamed({"_id": "_id2", "_hash": "_hash2"})
    both = keyed.join(settled, keyed["doc_id"].eqNullSafe(F.col("_id2")) & (keyed["text_hash"] == F.col("_hash2")), "left").join(found, same(keyed, found), "left")
    out = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return both.select("doc_id", "text", "settled", "found").mapInArrow(lambda it: removal_batches(it, width, texts), out)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, list(i) AS starts FROM h SEMI JOIN r USING (h) GROUP BY doc_id),
c AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM (SELECT doc_id, unnest(starts) AS i FROM s)) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, w,
             CASE WHEN gone IS NULL THEN range(1, len(w) + 1) ELSE [x FOR x IN range(1, len(w) + 1) IF NOT list_contains(gone, x)] END AS keep
      FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(list_select(w, keep), ' ')) AS kept_sha256 FROM k
"""
