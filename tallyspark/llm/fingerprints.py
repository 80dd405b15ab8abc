"""SimHash fingerprints of documents, and the search for all near ones.

Terms are pairs of neighbouring words (a text of one word has that word). Each term's
128 hash bits vote, once per occurrence: a fingerprint's bit is 1 if more than half of
the votes are. Votes are counted in packed sums, two 32-bit counters in one long, so that
64 plain sums over the exploded terms count all bits of all documents; no text of fewer
than 2**32 terms can overflow them. A text without words has the fingerprint 0.

`near_fingerprints` finds every pair of different fingerprints within a Hamming radius by
permuted block tables: bits are cut into radius + `spare` blocks; two fingerprints within
the radius agree in at least `spare` of them, so each choice of `spare` blocks is a table
whose key is those blocks' bits. Candidates share a key and are verified exactly in the
join, so only near pairs leave it. Members of a key with more than BLOCK of them are dealt
into blocks, and each pair of blocks is joined by itself.

Everything is DataFrame expressions. Null texts count as empty; null ids come before all
others, and equal ids in the order of a hash of their texts; rows that repeat id and text
are fingerprinted once and returned as often as they occur; an empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, join_split, text_of

BITS = 128
RADIUS = 3
SPARE = 2
BLOCK = 1024
#: Rows that one array of the result's repeats may stand for.
REPEATS = 100_000
LANES = 0x0000000100000001


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Hashes of the pairs of neighbouring words of a list."""
    n = F.size(w)
    none = F.array().cast("array<bigint>")
    return F.when(n > 1, F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))).otherwise(none)


def terms(w: Column) -> Column:
    """Hashes of the terms of a text with these words."""
    return F.when(F.size(w) == 1, F.transform(w, lambda a: F.xxhash64(a))).otherwise(pairs(w))


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _n, and the packed sums of the votes of `_terms`; rows with equal keys are one."""
    out = rows.select(*keys, F.explode_outer("_terms").alias("_h0")).withColumn("_h1", F.xxhash64("_h0", F.lit(1)))
    sums = [F.sum(F.shiftrightunsigned(f"_h{s}", i).bitwiseAND(F.lit(LANES))).alias(f"_s{s}_{i}") for s in range(BITS // 64) for i in range(32)]
    return out.groupBy(*keys).agg(F.count("_h0").alias("_n"), *sums)


def written(prefix: str = "") -> Column:
    """The fingerprint of counted votes."""
    return F.concat(*[_word(s, prefix) for s in range(BITS // 64)])


def fingerprint_votes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and `fingerprint` (32 hex digits); rows with equal keys are one document."""
    return counted(df.select(*keys, terms(words(F.col(text))).alias("_terms")), keys).select(*keys, written().alias("fingerprint"))


def _word(s: int, prefix: str) -> Column:
    """16 hex digits of the 64 bits whose votes are in the 32 sums of _h{s}."""
    word: Column = F.lit(0).cast("long")
    for i in range(32):
        v = F.coalesce(F.col(f"{prefix}_s{s}_{i}"), F.lit(0))
        low = F.when(v.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col(f"{prefix}_n"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        high = F.when(F.shiftrightunsigned(v, 32) * 2 > F.col(f"{prefix}_n"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        word = word.bitwiseOR(F.shiftleft(low, i)).bitwiseOR(F.shiftleft(high, i + 32))
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def halves(fingerprint: Column) -> list[Column]:
    """The fingerprint's 64-bit words as longs."""
    # conv gives an unsigned number, beyond a long's range for the upper half: joined from two parts
    part = lambda at: F.conv(F.substring(fingerprint, at, 8), 16, 10).cast("long")
    return [F.shiftleft(part(1 + 16 * s), 32).bitwiseOR(part(9 + 16 * s)) for s in range(BITS // 64)]


def hamming(a: Column, b: Column) -> Column:
    parts = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(halves(a), halves(b), strict=True)]
    return parts[0] + parts[1]


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of different bits."""
    return F.lit(1.0) - hamming(a, b) / F.lit(float(BITS))


def next_units(units: DataFrame, scratch: Scratch, per_range: int) -> DataFrame:
    """The units (doc_id, k1, k2, ...) with next_k1, next_k2: the keys of the one after it in order, after the last the first.

    Units are narrow rows. They are dealt into ranges of about `per_range`, whose number grows
    with theirs; the first of each range follows the last of the range before it.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("k2")]
    ranged = scratch.keep(units.repartitionByRange(max(1, units.count() // per_range), *order).withColumn("span", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("span").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "k2", "k1")).alias("first"))
    spans = Window.orderBy("span")  # one row a range
    after = F.coalesce(F.lead("first").over(spans), F.first("first").over(spans))
    after = firsts.select("span", after.alias("after"))
    following = F.lead(F.struct("k1", "k2")).over(Window.partitionBy("span").orderBy(*order))
    found = ranged.withColumn("following", following).join(after, "span")
    return found.select(*units.columns, *[F.coalesce(f"following.{k}", f"after.{k}").alias(f"next_{k}") for k in ("k1", "k2")])


def edited_fingerprints(docs: DataFrame, per_range: int = 200_000, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of documents and of their edits.

    A document's edit: its last floor(n / 4) code points are replaced by the first as many
    of the next document in ascending id (after the last one: the first). Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    near_prints: how many other fingerprints of documents are within `radius`.

    Order is found on narrow rows. Texts are shuffled once by key; each sends the part that the
    document before it needs to that one's key. Text and edit share their first words, whose
    votes are counted once.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    # rows that repeat id and text are one unit; null ids share k1 with id 0, but not k2
    base = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.when(F.col("doc_id").isNull(), F.bitwise_not("hash")).otherwise(F.col("hash")).alias("k2"))
    units = base.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.max(F.char_length("text")).alias("n_chars"))
    units = scratch.keep(next_units(scratch.keep(units, "units"), scratch, per_range), "next")
    scratch.drop("units", "ranged")

    texts = base.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    cut = F.floor(F.col("n_chars") / 4).cast("int").alias("cut")
    # each unit's last row is followed by the next unit, the rows before it by a repeat of it
    wanted = units.select(F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2"), F.col("k1").alias("to1"), F.col("k2").alias("to2"), cut, F.lit(False).alias("itself"))
    wanted = wanted.unionByName(units.where("rows > 1").select("k1", "k2", F.col("k1").alias("to1"), F.col("k2").alias("to2"), cut, F.lit(True).alias("itself")))
    heads = texts.join(wanted.hint("merge"), ["k1", "k2"]).select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), "cut", "itself", F.substring("text", F.lit(1), F.col("cut")).alias("head"))
    left = F.substring("text", F.lit(1), F.char_length("text") - F.col("cut"))
    rows = texts.join(heads.hint("merge"), ["k1", "k2"]).select("k1", "k2", "itself", "text", left.alias("left"), F.concat(left, "head").alias("edited"))
    rows = rows.select("k1", "k2", "itself", F.sha2("edited", 256).alias("edited_sha256"), words(F.col("text")).alias("w"), words(F.col("edited")).alias("e"), (F.size(words(F.col("left"))) - 1).alias("same"))
    tail = lambda w: F.slice(w, F.greatest("same", F.lit(1)), F.greatest(F.size(w), F.lit(1)))
    parts = [pairs(F.slice("w", F.lit(1), F.greatest("same", F.lit(0)))), F.when(F.col("same") > 0, pairs(tail(F.col("w")))).otherwise(terms(F.col("w"))), F.when(F.col("same") > 0, pairs(tail(F.col("e")))).otherwise(terms(F.col("e")))]
    keys = ["k1", "k2", "itself", "edited_sha256"]
    rows = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("part"), p.alias("_terms")) for i, p in enumerate(parts)])))
    sums = counted(rows, [*keys, "part"])
    both = [F.sum(F.when(F.col("part") != other, F.col(c))).alias(f"{name}{c}") for name, other in (("own", 2), ("new", 1)) for c in sums.columns if c.startswith("_")]
    prints = sums.groupBy(*keys).agg(*both).select(*keys, written("own").alias("fingerprint"), written("new").alias("edited_fingerprint"))
    prints = scratch.keep(prints, "prints")

    own = prints.where("not itself").select("k1", "k2", "fingerprint")
    near = near_fingerprints(own, radius)
    near = near.select("fingerprint").unionByName(near.select(F.col("other").alias("fingerprint"))).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("near_prints"))
    near = scratch.keep(near, "near")
    after = own.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("fingerprint").alias("next_print"))
    out = prints.join(units.hint("merge"), ["k1", "k2"]).join(after.hint("merge"), ["next_k1", "next_k2"]).join(near, "fingerprint", "left")
    next_print = F.when(F.col("itself"), F.col("fingerprint")).otherwise(F.col("next_print"))
    # all rows of a unit but its last are followed by themselves
    times = F.when(F.col("itself"), F.col("rows") - 1).otherwise(F.lit(1))
    out = out.withColumn("_times", times).withColumn("_many", F.explode(F.expr(f"sequence(0, (_times - 1) div {REPEATS})")))
    out = out.withColumn("_one", F.explode(F.expr(f"sequence(1, least({REPEATS}, _times - _many * {REPEATS}))")))
    return out.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), next_print).alias("near_next"), F.coalesce("near_prints", F.lit(0)).alias("near_prints"),
    )


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, spare: int = SPARE, block: int = BLOCK) -> DataFrame:
    """All pairs of different fingerprints within `radius`: fingerprint, other (the larger), distance.

    prints: a column `fingerprint`. Equal ones are one row here; members of a fingerprint are
    found by joining with the table again.
    """
    blocks = radius + spare
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    distinct = prints.select("fingerprint").where("fingerprint is not null").distinct()
    a, b = halves(F.col("fingerprint"))
    bit_string = F.concat(*[F.lpad(F.bin(x), 64, "0") for x in (a, b)])
    chosen = [F.substring(F.col("_bits"), edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)]
    keys = F.array(*[F.xxhash64(F.lit(t), *[chosen[i] for i in some]) for t, some in enumerate(combinations(range(blocks), spare))])
    keyed = distinct.withColumn("_bits", bit_string).select("fingerprint", a.alias("_a"), b.alias("_b"), F.explode(keys).alias("_key"))
    # keys of one fingerprint have no pairs; those of many are dealt into pairs of blocks
    several = keyed.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_members")).where("_members > 1").drop("_members")
    members = join_split(keyed, several, "_key").withColumn("_own", F.pmod(F.xxhash64("fingerprint"), F.col("_blocks")).cast("int"))
    one = members.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_with"))
    side = lambda **names: one.select("_key", F.least("_own", "_with").alias("_i"), F.greatest("_own", "_with").alias("_j"), "_own", *[F.col(x).alias(y) for x, y in names.items()])
    mine = side(fingerprint="fingerprint", _a="_a", _b="_b")
    other = side(fingerprint="other", _a="_c", _b="_d").withColumnsRenamed({"_key": "_key2", "_i": "_i2", "_j": "_j2", "_own": "_own2"})
    distance = F.bit_count(F.col("_a").bitwiseXOR(F.col("_c"))) + F.bit_count(F.col("_b").bitwiseXOR(F.col("_d")))
    same = (F.col("_key") == F.col("_key2")) & (F.col("_i") == F.col("_i2")) & (F.col("_j") == F.col("_j2"))
    across = (F.col("_i") == F.col("_j")) | (F.col("_own") != F.col("_own2"))
    found = mine.join(other, same & across & (F.col("fingerprint") < F.col("other")) & (distance <= radius))
    return found.select("fingerprint", "other", distance.alias("distance")).distinct()
