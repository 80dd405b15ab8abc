"""Near-duplicate groups by BagMinHash signatures of five-word shingles.

Likeness of two documents is the weighted Jaccard similarity of their multisets of
shingles (texts of fewer than five words have one shingle of all their words); documents
whose likeness is at least `least` are linked, and a group is a connected component.

1. Signatures (BagMinHash): a shingle that occurs w times owns the weights [0, w). Weights
   are cut into the shells [0,1), [1,2), [2,4), [4,8), ...; each shell has a Poisson
   process of points in time, with a rate of its width, and each point has a weight in the
   shell and one of SIZE components, all drawn from hashes of shingle, shell and number. A
   component keeps its earliest point whose weight is below w. Two components are equal
   with a probability of exactly the weighted Jaccard similarity. A process stops at the
   first point later than all components of its document.
2. Rows with one word sequence become one text, a node; all that follows is on nodes.
3. Bands of ROWS components are keys; nodes that share a key are candidates. Signatures that
   agree in at least NEAR components are near; at a likeness of 0.8 a pair agrees in fewer
   with a chance of 2.7e-8, and shares no key with one of 4.7e-8. Every member of a key is
   compared with the key's smallest member, and near ones form clusters. Keys whose members
   are in several clusters are then searched in full: members are dealt into blocks of about
   BLOCK, every pair of blocks (but those of the key's largest cluster with each other)
   compares its signatures as arrays and gives a spanning forest of the near pairs between
   clusters. Every link between nodes that share a key is now within a cluster.
4. Clusters are verified on texts in two steps. First the members of a cluster are dealt
   into blocks of about FIRST_BLOCK texts or BLOCK_BYTES, and about HUBS members go to every block:
   n members make about n * (1 + HUBS / FIRST_BLOCK) rows. A block computes all overlaps of its
   multisets as one matrix product and gives a spanning forest of the true links. Only
   members that are not linked to the cluster's largest part then meet all its blocks.
   Groups are the components.

The second steps of 3 and 4 send m members that stand apart to m * n / BLOCK rows, so what
is quadratic is a cluster whose members are near each other without being linked. No link
is lost to a choice of representatives, no list of all pairs is ever made, and no key or
cluster is gathered in one task. What grows with the data is never broadcast.

Components and links stay in Spark tables. Texts without words form one group. Repeated
rows are members of their group; rows with one id and different texts join their groups.
Null ids have a null class if no row of the group has an id. An empty table gives an empty
result. Other columns, whatever their names, are passed on by `drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_long, chunks, free_name, join_split, lists, mix, quoted, sequence_hash, ship
from .graphs import components

SHINGLE = 5
LEAST = 0.8
SIZE = 128
ROWS = 4
BLOCK = 256
BLOCK_BYTES = 2 << 20
FIRST_BLOCK = 64
#: Bits of the map of rows whose texts are read again: 32 MB.
MOST_BITS = 1 << 28
HUBS = 8
NEAR = 76

_TO_UNIT = 1.0 / (1 << 53)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts in turn, and n+1 offsets."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    at = first[:-1][owner] + np.arange(offsets[-1]) - offsets[:-1][owner]
    left = first[1:][owner] - at  # words from here to the end of the text
    factors = mix(np.arange(width, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(width):
        inside = left > j
        out[inside] += hashes[at[inside] + j] * factors[j]
    return mix(out), offsets


def weighted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) pairs: document numbers, shingles, counts."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], v[at], np.diff(np.append(at, len(v)))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _TO_UNIT


def bag_minhash(owner: np.ndarray, values: np.ndarray, counts: np.ndarray, documents: int, size: int = SIZE) -> np.ndarray:
    """documents x size signature components (32 bits); documents without shingles have zeros."""
    # one process for each shell that begins below the weight
    shells = np.where(counts > 1, np.floor(np.log2(np.maximum(counts - 1, 1))).astype(np.int64) + 2, 1)
    who = np.repeat(np.arange(len(values)), shells)
    shell = np.arange(len(who)) - np.repeat(np.cumsum(shells) - shells, shells)
    low = np.where(shell == 0, 0.0, 2.0 ** (shell - 1))
    width = np.where(shell == 0, 1.0, low)
    doc, weight = owner[who], counts[who].astype(np.float64)
    state = mix(values[who] ^ mix(shell.astype(np.uint64) + np.uint64(0x5EED)))
    # times are whole multiples of 2**-40, so sums don't depend on how points are drawn in blocks
    best = np.full(documents * size, np.iinfo(np.int64).max)
    time = np.zeros(len(who), dtype=np.int64)
    number = 0
    present = np.bincount(owner, minlength=documents) > 0
    while len(who):
        # documents of few shingles need many points of each: draw those in blocks
        block = 1 if len(who) > 4096 else 16
        step = np.arange(number, number + block, dtype=np.uint64)
        a = mix(state[:, None] + step[None, :] * np.uint64(0xD1342543DE82EF95))
        b = mix(a ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        waits = np.floor(np.log(_unit(a)) * (-(2.0**40) / width[:, None])).astype(np.int64)
        times = time[:, None] + np.cumsum(waits, axis=1)
        component = (b >> np.uint64(40)).astype(np.int64) % size
        at = low[:, None] + ((b & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32 * width[:, None]
        taken = at < weight[:, None]
        slot = doc[:, None] * size + component
        np.minimum.at(best, slot[taken], times[taken])
        number += block
        time = times[:, -1]
        latest = best.reshape(documents, size).max(axis=1)
        on = time < latest[doc]
        if not on.all():
            doc, weight, state, low, width, time = doc[on], weight[on], state[on], low[on], width[on], time[on]
            who = who[on]
    out = (mix(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(documents, size)
    out[~present] = 0
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """documents x bands 64-bit keys."""
    bands = signatures.shape[1] // rows
    keys = np.tile(mix(np.arange(bands, dtype=np.uint64)), (len(signatures), 1))
    part = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    for j in range(rows):
        keys = mix(keys ^ (part[:, :, j] + np.uint64(j << 40)))
    return keys


def sketch_batches(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The other columns of each row with the hash of its word sequence, its signature and its keys."""
    for batch in batches:
        for c in chunks(batch.column("text")):
            h = c.hashes()
            values, offsets = shingles(h, c.first)
            owner, v, n = weighted(values, offsets)
            docs = c.hi - c.lo
            signatures = bag_minhash(owner, v, n, docs, size)
            keys = band_keys(signatures, rows)
            root = np.stack([sequence_hash(h, c.first, 1), sequence_hash(c.hashes(1), c.first, 2)], axis=1)
            filled = c.n_words > 0
            keys_of = lists(as_long(keys[filled].ravel()), np.where(filled, keys.shape[1], 0), pa.int64())
            others = [n for n in batch.schema.names if n != "text"]
            columns = [pa.array([x.tobytes() for x in root], pa.binary()), pa.array([x.tobytes() for x in signatures], pa.binary()), keys_of]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(c.lo, docs) for n in others), *columns], [*others, "root", "signature", "bands"])


class Forest:
    """Components of n things; `join` says which pairs are new links between them."""

    def __init__(self, labels: np.ndarray):
        self.labels = np.unique(labels, return_inverse=True)[1]

    def join(self, x: int, hits: np.ndarray) -> list[int]:
        """Links x with the hits of other components, one for each component."""
        own = self.labels[x]
        found = self.labels[hits]
        others, at = np.unique(found, return_index=True)
        new = others != own
        if not new.any():
            return []
        self.labels[np.isin(self.labels, others[new])] = own
        return hits[at[new]].tolist()


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first `keys` columns; each such group is small."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        at = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def forest_links(group: pa.Table, near: np.ndarray) -> tuple[list, list]:
    """Links that join what the pairs of `near` (a symmetric matrix) join, of those that this pair of blocks is to compare.

    Each joined node is linked to the smallest one of those it was joined with, which leaves
    little to do for the components.
    """
    ids, own = group.column("node").to_numpy(), group.column("own").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    forest = Forest(group.column("part").to_numpy())
    others = np.flatnonzero(own == j)
    joined: set[int] = set()
    for x in np.flatnonzero(own == i).tolist():
        if found := forest.join(x, others[near[x, others]]):
            joined.update([x, *found])
    at = np.array(sorted(joined), dtype=np.int64)
    if not len(at):
        return [], []
    _, which = np.unique(forest.labels[at], return_inverse=True)
    least = np.full(which.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids[at])
    return ids[at].tolist(), least[which].tolist()


def link_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def signature_links(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    """Near pairs of each pair of blocks."""
    for group in groups_of(batches, 3):
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=np.uint32).reshape(len(group), -1)
        close = np.zeros((len(group), len(group)), dtype=bool)
        for x in range(len(group)):
            close[x] = (sig == sig[x]).sum(axis=1) >= near
        yield link_batch(*forest_links(group, close))


def overlaps(texts: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of texts; of two texts without words it is 1."""
    owner, keys, at = [], [], 0
    for c in chunks(texts):
        values, offsets = shingles(c.hashes(), c.first)
        o, v, n = weighted(values, offsets)
        # the k-th occurrence of a shingle is a thing of its own, so sets of these overlap as multisets do
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner.append(np.repeat(o, n) + at)
        keys.append(mix(np.repeat(v, n) ^ mix(nth.astype(np.uint64))))
        at += c.hi - c.lo
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    size = np.bincount(owner, minlength=at).astype(np.float64)
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(begin, len(k)))
    column = np.repeat(np.cumsum(times > 1) - 1, times)
    shared = np.repeat(times > 1, times)
    column, o = column[shared], o[shared]
    both = np.zeros((at, at), dtype=np.float64)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = np.zeros((at, width), dtype=np.float32)
        part[o[a:b], column[a:b] - n * width] = 1
        both += part @ part.T
    either = size[:, None] + size[None, :] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def text_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of each pair of blocks, from the texts."""
    for group in groups_of(batches, 3):
        yield link_batch(*forest_links(group, overlaps(group.column("text").combine_chunks()) >= least))


def blocks_of(n: str, block: int, bytes_of: str | None = None, block_bytes: int = BLOCK_BYTES) -> Column:
    """The number of blocks of `n` members, of `bytes_of` bytes together."""
    count = F.ceil(F.col(n) / block)
    return (count if bytes_of is None else F.greatest(count, F.ceil(F.col(bytes_of) / block_bytes))).cast("int")


def in_blocks(members: DataFrame) -> DataFrame:
    """Members dealt to the pairs of blocks of their key that are to be compared: key, i, j, own, ..., sorted.

    Pairs are dealt by range, which gives tasks equal numbers of rows; by hash, several of a large
    key's pairs would meet in one task.

    members: key, node, main (part of the key's largest part, which needs no comparison
    within itself), main_blocks, rest_blocks (blocks of the key for members of both kinds),
    and others. Blocks of the rest meet all blocks, those of the main part only those of the
    rest.
    """
    rest, hashed = F.col("rest_blocks"), F.xxhash64("node")
    own = F.when(F.col("main"), rest + F.pmod(hashed, F.greatest("main_blocks", F.lit(1))).cast("int")).otherwise(F.pmod(hashed, F.greatest(rest, F.lit(1))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(F.col("main"), rest).otherwise(rest + F.col("main_blocks")) - 1)
    meets = F.transform(meets, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    others = [c for c in members.columns if c not in ("key", "main", "main_blocks", "rest_blocks")]
    dealt = members.withColumn("own", own).withColumn("meet", F.explode(meets))
    return dealt.select("key", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "own", *others).repartitionByRange("key", "i", "j").sortWithinPartitions("key", "i", "j")


def apart(placed: DataFrame, block: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Keys whose members (key, node, part, bytes) are in several parts: key, largest (their largest part), main_blocks, rest_blocks."""
    sizes = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    first = F.struct("n", "part")
    keys = sizes.groupBy("key").agg(
        F.max_by("part", first).alias("largest"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.max_by("bytes", first).alias("bytes_main"), F.sum("bytes").alias("bytes"),
    )
    keys = keys.withColumns({"n_rest": F.col("n") - F.col("n_main"), "bytes_rest": F.col("bytes") - F.col("bytes_main")}).where("n_rest > 0")
    return keys.select("key", "largest", blocks_of("n_main", block, "bytes_main", block_bytes).alias("main_blocks"), blocks_of("n_rest", block, "bytes_rest", block_bytes).alias("rest_blocks"))


def near_clusters(nodes: DataFrame, scratch: Scratch, near: int, block: int) -> DataFrame:
    """node, component: clusters of near signatures among the nodes that share keys."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    grouped = scratch.keep(join_split(keyed, hubs, "key"), "grouped")
    signatures = nodes.select("node", "signature")
    pairs = grouped.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    sig = lambda x: signatures.select(F.col("node").alias(x), F.col("signature").alias(f"sig_{x}"))
    compared = pairs.join(sig("a").hint("merge"), "a").join(sig("b").hint("merge"), "b")
    links = scratch.keep(compared.mapInArrow(lambda it: pair_links(it, near), "a long, b long"), "near")
    parts = components(links, scratch, "first")

    placed = grouped.join(parts.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"), F.lit(0).alias("bytes"))
    placed = scratch.keep(placed, "placed")
    scratch.drop("grouped")
    members = join_split(placed, apart(placed, block), "key").join(signatures.hint("merge"), "node")
    members = members.select("key", (F.col("part") == F.col("largest")).alias("main"), "main_blocks", "rest_blocks", "node", "part", "signature")
    more = scratch.keep(in_blocks(members).mapInArrow(lambda it: signature_links(it, near), "a long, b long"), "more")
    scratch.drop("placed")
    if more.isEmpty():
        return parts
    clusters = components(links.unionByName(more), scratch, "second")
    scratch.drop("near", "more", "first")
    return clusters


def pair_links(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for x in ("sig_a", "sig_b"))
        yield batch.filter(pa.array((a == b).sum(axis=1) >= near)).select(["a", "b"])


def picked(rows: DataFrame, wanted: DataFrame, keys: list[str], most_bits: int = MOST_BITS) -> DataFrame:
    """Rows whose keys are in `wanted`, and few others, told before any shuffle by a bit map of hashed keys.

    The map has 16 to 32 bits for each wanted row, and `most_bits` at most, in pieces of 4 KB, so what is sent to all is
    bounded; a full map lets more rows through and loses none.
    """
    bits = 1 << 15
    while bits < min(most_bits, 16 * wanted.count()):
        bits *= 2
    piece, bit, held = (free_name(rows, x) for x in ("piece", "bit", "held"))
    spot = F.pmod(F.xxhash64(*keys), F.lit(bits)).cast("long")
    marks = lambda df: df.withColumns({piece: F.shiftright(spot, 15), bit: spot.bitwiseAND(F.lit(32767))})
    table = marks(wanted).groupBy(piece).agg(F.bitmap_construct_agg(bit).alias(held))
    found = marks(rows).join(F.broadcast(table), piece)
    byte = F.conv(F.hex(F.substring(held, F.expr(f"cast(`{bit}` div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1).select(*map(quoted, rows.columns))


def true_links(base: DataFrame, nodes: DataFrame, clusters: DataFrame, scratch: Scratch, least: float, block: int, block_bytes: int) -> DataFrame:
    """a, b: links that join all members of a cluster whose texts are linked, directly or through others."""
    members = clusters.join(nodes.select("node", "doc_id", "text_hash", "bytes").hint("merge"), "node").withColumnRenamed("component", "key")
    members = scratch.keep(members, "members")
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all_bytes"), F.min("node").alias("least"))
    counts = counts.select("key", "n", "least", blocks_of("n", min(block, FIRST_BLOCK), "all_bytes", block_bytes).alias("blocks"))
    hashed = F.xxhash64("node", F.lit(1))
    hub = (F.col("node") == F.col("least")) | (F.pmod(hashed, F.col("n")) < HUBS)
    own = F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(hashed, F.col("blocks")).cast("int")))
    dealt = join_split(members, counts, "key").select("key", "node", "bytes", "doc_id", "text_hash", own.alias("own"))
    # one row of each node gives the text; equal rows are one before they are dealt out
    place = lambda df: df.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    # only texts of members are shuffled: those of other rows fail a map of the members' hashes
    rows = picked(place(base), place(members), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    texts = scratch.keep(rows.join(place(dealt).hint("merge"), ["doc_id", "text_hash"]).select("key", "node", "bytes", "own", "text"), "texts")
    scratch.drop("members")

    blocks = texts.select("key", F.explode("own").alias("i"), "node", F.col("node").alias("part"), "text").withColumn("j", F.col("i")).withColumn("own", F.col("i"))
    blocks = blocks.select("key", "i", "j", "own", "node", "part", "text").repartitionByRange("key", "i").sortWithinPartitions("key", "i")
    links = scratch.keep(blocks.mapInArrow(lambda it: text_links(it, least), "a long, b long"), "links")
    scratch.drop("first", "second")
    parts = components(links, scratch, "blocks")

    placed = texts.select("key", "node", "bytes").join(parts.hint("merge"), "node", "left").select("key", "node", "bytes", F.coalesce("component", "node").alias("part"))
    placed = scratch.keep(placed, "parted")
    rest = join_split(placed, apart(placed, block, block_bytes), "key").join(texts.select("node", "text").hint("merge"), "node")
    rest = rest.select("key", (F.col("part") == F.col("largest")).alias("main"), "main_blocks", "rest_blocks", "node", "part", "text")
    more = scratch.keep(in_blocks(rest).mapInArrow(lambda it: text_links(it, least), "a long, b long"), "more-links")
    scratch.drop("parted", "texts", "blocks")
    return links.unionByName(more)


def near_groups(
    docs: DataFrame, least: float = LEAST, size: int = SIZE, rows: int = ROWS, block: int = BLOCK, near: int = NEAR, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its group), class_size, kept (is that id)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "minhash")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sized = base.select("doc_id", "text_hash", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    kinds = "doc_id long, text_hash long, bytes long, root binary, signature binary, bands array<long>"
    sketches = scratch.keep(sized.mapInArrow(lambda it: sketch_batches(it, size, rows), kinds), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "bytes")).alias("first")
    nodes = sketches.groupBy("root").agg(first, F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    numbered = nodes.select(F.monotonically_increasing_id().alias("node"), "root", "first.doc_id", "first.text_hash", "first.bytes", "copies", "signature", "bands")
    nodes = scratch.keep(numbered, "nodes")
    rooted = scratch.keep(sketches.select("doc_id", "root"), "rooted")
    scratch.drop("sketches")
    links = true_links(base, nodes, near_clusters(nodes, scratch, near, block), scratch, least, block, block_bytes)
    # ids with several word sequences
    several = rooted.where("doc_id is not null").groupBy("doc_id").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("doc_id")
    known = rooted.join(several.hint("merge"), "doc_id").distinct().join(nodes.select("root", "node").hint("merge"), "root")
    known = scratch.keep(known.select("doc_id", F.col("node").alias("a")), "known")
    across = known.join(known.groupBy("doc_id").agg(F.min("a").alias("b")).hint("merge"), "doc_id").select("a", "b")
    parts = components(links.unionByName(across), scratch, "classes")

    classes = nodes.select("node", "root", "doc_id", "copies").join(parts.hint("merge"), "node", "left").select("root", "doc_id", "copies", F.coalesce("component", "node").alias("class"))
    classes = scratch.keep(classes, "placed-classes")
    scratch.drop("nodes", "links", "more-links", "known", "classes")
    sizes = classes.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = scratch.keep(join_split(classes, sizes, "class").select("root", "class_id", "class_size"), "named")
    scratch.drop("placed-classes")
    marked = rooted.join(named.hint("merge"), "root")
    return marked.select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, by_id: bool = True, **how) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest id, null ids last.

    With `by_id` rows of one id are one document, as in near_groups, and one of them stays;
    else a row is known by its text alone, and only near copies are dropped.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    # rows get numbers of their own and are written with them, as ids may be null or repeated
    row = free_name(docs, "row_number")
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    narrow = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    own = Scratch(docs.sparkSession, "minhash")
    grouped = near_groups(narrow.select(F.col("row").alias("doc_id"), "text"), scratch=own, **how).select(F.col("doc_id").alias("row"), F.col("class_id").alias("class"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "row")
    placed = scratch.keep(narrow.select("row", order.alias("order")).join(grouped.hint("merge"), "row"), "placed")
    own.drop("rooted", "named")
    if by_id:
        known = placed.where("order.id is not null")
        firsts = known.groupBy(F.col("order.id").alias("id")).agg(F.min("class").alias("b"))
        links = known.select(F.col("order.id").alias("id"), F.col("class").alias("a")).distinct().join(firsts.hint("merge"), "id").select("a", "b")
        parts = components(links, scratch, "ids")
        placed = placed.join(parts.hint("merge"), F.col("class") == F.col("node"), "left").select("order", F.coalesce("component", "class").alias("class"))
    kept = placed.groupBy("class").agg(F.min("order").alias("order")).select(F.col("order.row").alias(row))
    return rows.join(kept.hint("merge"), row).select(*map(quoted, docs.columns))
