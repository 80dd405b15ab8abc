"""Mixing of sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership
pattern (the sorted set of their sources), and only that table, one row per pattern,
goes to the driver; more than `max_patterns` patterns are an error, never a silent cut.

Targets: all sources together are to give `share` of all words, split by weight; a
source whose part exceeds `most_repeats` times its size stops there, and the excess goes
to the others by weight until none is above (water filling, solved in one sorted sweep).

Flow: source of the network -> pattern -> data source -> sink. The r-th copy of a
pattern's words is an arc of capacity "words of the pattern" and cost r, so costs are
convex in repetition and every first copy is used before any second one. Sinks have the
targets as capacities. Successive shortest paths give the cheapest maximal flow.

Selection: the documents of a pattern are ordered by a seeded hash; a copy that may take
f words takes documents from the start of that order until f words are reached, the last
of them in part. Running totals come from sums over 4096 ranges of the hash: only the
documents of the one range in which a copy's end falls are ordered in a window, so no
pattern is gathered in one task.

Null texts have no words; null sources are a source of their own, after all others. The
order is by a hash of seed, id and text, then by id and by another hash of the text, so null
and repeated ids are dealt over all ranges, each row is planned by itself, and only rows that
are equal in id and text are ordered arbitrarily (what they take together is the same). An
empty table gives an empty result; sources without words have the target 0. The mix keeps all
columns, whatever their names. More than MAX_PATTERNS patterns are an error.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, free_name, quoted, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
MAX_PATTERNS = 200_000
RANGES = 4096
SEED = 7


def word_count(column: str = "text") -> Column:
    text = text_of(column)
    bare = F.regexp_replace(F.regexp_replace(text, "^" + SPACE, ""), SPACE + r"\z", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE, -1))).cast("long")


def target_words(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """Targets of the sources: `share` of all words by weight, none above `most` times its size."""
    total = share * sum(sizes)
    targets = [0.0] * len(sizes)
    left, weight = total, float(sum(weights))
    # sources reach their limits in the order of limit / weight
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for k, i in enumerate(order):
        if most * sizes[i] * weight <= left * weights[i]:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
            weight -= weights[i]
        else:
            for j in order[k:]:
                targets[j] = left * weights[j] / weight
            break
    return targets


class FlowNetwork:
    """Min-cost flow by successive shortest paths with potentials; integer capacities and costs >= 0."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        n = len(self.out)
        potential = [0] * n
        while True:
            far = [-1] * n
            via = [-1] * n
            done = [False] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if done[x]:
                    continue
                done[x] = True
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] and not done[y]:
                        new = d + self.cost[e] + potential[x] - potential[y]
                        if far[y] < 0 or new < far[y]:
                            far[y], via[y] = new, e
                            heapq.heappush(heap, (new, y))
            if far[sink] < 0:
                return
            longest = max(far)
            potential = [p + (f if f >= 0 else longest) for p, f in zip(potential, far, strict=True)]
            # push along every tree path of this length that still has room, by depth-first search
            self._push(source, sink, potential)

    def _push(self, source: int, sink: int, potential: list[int]) -> None:
        """A blocking flow over the arcs of reduced cost 0."""
        while True:
            at = [0] * len(self.out)
            path: list[int] = []
            seen = [False] * len(self.out)
            seen[source] = True
            x, pushed = source, False
            while True:
                if x == sink:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    pushed = True
                    path, x = [], source
                    seen = [False] * len(self.out)
                    seen[source] = True
                    continue
                for i in range(at[x], len(self.out[x])):
                    e = self.out[x][i]
                    y = self.to[e]
                    if self.room[e] and not seen[y] and self.cost[e] + potential[x] - potential[y] == 0:
                        at[x] = i
                        path.append(e)
                        seen[y] = True
                        x = y
                        break
                else:
                    at[x] = len(self.out[x])
                    if not path:
                        break
                    x = self.to[path.pop() ^ 1]
            if not pushed:
                return


def route(patterns: list[tuple[tuple[int, ...], int]], targets: list[int], most: int) -> list[list[int]]:
    """Words that each copy of each pattern gives, [pattern][copy], by min-cost flow to the sources' targets."""
    p, s = len(patterns), len(targets)
    net = FlowNetwork(2 + p + s)
    source, sink = 0, 1 + p + s
    copies = [[net.arc(source, 1 + i, words, r) for r in range(most)] for i, (_, words) in enumerate(patterns)]
    for i, (members, words) in enumerate(patterns):
        for k in members:
            net.arc(1 + i, 1 + p + k, words * most, 0)
    for k, t in enumerate(targets):
        net.arc(1 + p + k, sink, t, 0)
    net.solve(source, sink)
    return [[net.room[e ^ 1] for e in row] for row in copies]


def mix_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, max_patterns: int = MAX_PATTERNS):
    """(patterns as lists of source names, their words, copies' words, sources, sizes, targets) of documents with `_members`, `size`."""
    rows = sized.groupBy("_members").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    names = sorted({x for r in rows for x in r["_members"]}, key=lambda x: (x is None, x or ""))
    index = {x: i for i, x in enumerate(names)}
    rows = sorted(rows, key=lambda r: [index[x] for x in r["_members"]])
    patterns = [(tuple(sorted({index[x] for x in r["_members"]})), int(r["words"])) for r in rows]
    sizes = [0] * len(names)
    for members, words in patterns:
        for k in members:
            sizes[k] += words
    each = [float(weights[i % len(weights)]) for i in range(len(names))]
    total = sum(w for _, w in patterns)
    # with overlapping sources the share is of all words, counted once
    targets = target_words(sizes, each, share * total / max(1, sum(sizes)), most)
    copies = route(patterns, [round(t) for t in targets], most)
    return [r["_members"] for r in rows], patterns, copies, names, sizes, targets


def mix_sources(docs: DataFrame, members: Column | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seed: int = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, members (sources), size, source_size and target (of its first source), taken, copies (words of each copy), and the columns `also`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    members = F.array(F.col("source").cast("string")) if members is None else F.array_sort(F.array_distinct(members))
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = docs.select("doc_id", *also, members.alias("_members"), word_count().alias("size"), order.alias("_order"), F.xxhash64("text").alias("_tie"))
    sized = scratch.keep(sized.withColumn("_range", F.pmod(F.shiftright("_order", 12), F.lit(RANGES))), "sized")
    names, patterns, copies, sources, sizes, targets = mix_plan(sized, weights, share, most)
    plan = [
        (list(n), i, patterns[i][1], float(sizes[patterns[i][0][0]]) if patterns[i][0] else 0.0, targets[patterns[i][0][0]] if patterns[i][0] else 0.0, copies[i])
        for i, n in enumerate(names)
    ]
    table = spark.createDataFrame(plan, "_members array<string>, _pattern int, _words long, _source_size double, target double, _copies array<long>")
    # at most max_patterns rows
    marked = sized.withColumn("_key", F.to_json(F.struct("_members"), {"ignoreNullFields": "false"})).join(
        F.broadcast(table.withColumn("_key", F.to_json(F.struct("_members"), {"ignoreNullFields": "false"})).drop("_members")), "_key"
    )
    ranges = marked.groupBy("_pattern", "_range").agg(F.sum("size").alias("_in_range"), F.first("_copies").alias("_copies"))
    before = Window.partitionBy("_pattern").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
    # ranges in which a copy ends: at most `most` per pattern
    cut = F.exists("_copies", lambda f: (f > F.col("_before")) & (f < F.col("_before") + F.col("_in_range")))
    ranges = scratch.keep(ranges.select("_pattern", "_range", "_before", "_in_range", cut.alias("_cut")), "ranges")
    placed = marked.join(ranges, ["_pattern", "_range"])
    within = Window.partitionBy("_pattern", "_range").orderBy("_order", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = placed.where("_cut").withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    whole = placed.where("not _cut").withColumn("_at", F.col("_before"))
    # a copy takes the words of [0, f) of its pattern's order; outside the cut ranges a document is in it or not
    got = F.transform("_copies", lambda f: F.when(F.col("_cut"), F.greatest(F.lit(0), F.least(F.col("size"), f - F.col("_at")))).when(f > F.col("_before"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    return whole.unionByName(at_cut).select(
        "doc_id",
        F.col("_members").alias("members"),
        "size",
        F.col("_source_size").cast("long").alias("source_size"),
        "target",
        F.aggregate(got, F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
        got.alias("copies"),
        *also,
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row once for every copy that takes words of it, cut to its words where a copy ends."""
    row, size, taken = (free_name(docs, n) for n in ("row_number", "mix_size", "mix_words"))
    # rows get numbers of their own and are written with them, as ids may be null or repeated
    rows = Scratch(docs.sparkSession, "mixed").keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    mix = mix_sources(rows.select("doc_id", "text", "source", row), also=(row,), **how).where("taken > 0")
    mix = mix.select(row, F.col("size").alias(size), F.explode(F.filter("copies", lambda x: x > 0)).alias(taken))
    joined = rows.join(mix.hint("merge"), row)
    words = F.split(F.regexp_replace(text_of(), r"\A" + SPACE, ""), SPACE, -1)
    part = F.col(taken) < F.col(size)
    text = F.when(part, F.array_join(F.slice(words, F.lit(1), F.col(taken).cast("int")), " ")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(part, F.char_length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])
