"""Importance resampling and hard negatives against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import common, importance, negatives

from .helpers import frame, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(deadline=None, max_examples=60)
@given(st.binary(min_size=1, max_size=400), st.lists(st.tuples(st.integers(0, 399), st.integers(1, 400)), min_size=1, max_size=8), st.sampled_from([1, 3, 64]))
def test_crcs_of_spans(data, spans, width):
    spans = [(a % len(data), n) for a, n in spans]
    spans = [(a, min(a + n, len(data))) for a, n in spans]
    got = importance.SpanCrc(width)(np.frombuffer(data, dtype=np.uint8), *map(np.array, zip(*spans, strict=True)))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


def plain_features(text, longest):
    own = WORD.findall((text or "").translate(LOWER))
    return [" ".join(own[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(own) - n + 1)]


def plain_scores(rows, target, buckets, longest, seed=2024):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in plain_features(t, longest))
    s, t = count(x for _, x in rows), count(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc_id, text in rows:
        own = plain_features(text, longest)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in own) // max(len(own), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(plain_features(text, 1)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


TEXTS = [None, "", "  \n", "!?", "ONE", "Straße ÉTÉ été été", "x" * 5000, " ".join(["y" * 200] * 30), *[prose(i, 3 + 7 * i) for i in range(40)], prose(3, 24), prose(3, 24), prose(99, 60_000, 3000)]


@pytest.mark.parametrize("longest", [1, 3])
def test_scores_and_ranks(spark, longest):
    rows = frame(spark, TEXTS).withColumn("rank", F.lit("a name of ours"))
    extra = spark.createDataFrame([(None, prose(5, 30)), (7, prose(5, 30)), (7, prose(5, 30))], "doc_id long, text string")
    rows = rows.unionByName(extra, allowMissingColumns=True)
    target = [prose(1000 + i, 50) for i in range(5)] + [None]
    got = importance.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, min_words=20, buckets=97, longest=longest).collect()
    want = plain_scores([(r.doc_id, r.text) for r in rows.collect()], target, 97, longest)
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
    fit = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[2], r[3]))[: 30 * sum(r[1] >= 20 for r in want) // 100]
    assert [tuple(r)[:5] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == fit
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(fit) + 1))
    kept = importance.drawn_documents(rows, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, min_words=20, buckets=97, longest=longest)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in fit}


def test_nothing_to_draw(spark):
    none = frame(spark, ["x"]).limit(0)
    assert importance.resample(none, none.select("text")).count() == 0
    (row,) = importance.resample(frame(spark, [None]), none.select("text")).collect()
    assert (row.n_features, row.weight, row["rank"]) == (0, 0, None)


def test_long_features_do_not_depend_on_their_chunk():
    texts = [" ".join("z" * n for n in range(1, 300, 7)), "a b", "", "q" * 64 + " " + "q" * 65]
    (c,) = common.chunks(pa.array(texts), kinds=importance.FEATURE_BYTES)
    crcs, owner = importance.features(c, 2)
    for i, t in enumerate(texts):
        assert Counter(crcs[owner == i].tolist()) == Counter(map(zlib.crc32, plain_features(t, 2)))


SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, positives=5, negatives_=3, low=50, high=95):
    fit = [(i, tuple(math.floor(256 * float(x)) for x in v), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, y in fit:
        if i % 50:
            continue
        scored = [(-dot(v, w), j, z) for j, w, z in fit if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            inside = sorted(x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s)[:negatives_]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(inside)]
    return sorted(out)


def vectors(n, dims, seed, centers=6):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centers, dims))
    x = middle[r.integers(0, centers, n)] + 0.3 * r.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("how", [{}, {"sample": 200, "splits": 4, "leaf_rows": 40, "block_rows": 16, "block_anchors": 7, "run_blocks": 3}])
def test_hard_negatives(spark, how):
    x = vectors(900, 8, 3)
    x[300:600] = x[300]  # one very common vector, of several labels
    rows = [(i, [float(c) for c in v], int(i % 4)) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 1), (1050, [1.0] * 8, None), (None, [1.0] * 8, 1), (1100, [nan] * 8, 1), (1150, [inf] + [0.0] * 7, 1), (1200, [None] + [0.0] * 7, 1), (1250, [], 1), (1300, [1.0], 2), (1301, [0.0] * 8, 2), (1350, [-0.4] * 8, 3)]
    df = spark.createDataFrame([*rows, *odd], SCHEMA).withColumns({"block": F.lit(1), "Score": F.lit("x")})
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives([*rows, *odd])


def test_few_rows_and_none(spark):
    some = [(50, [1.0, 0.0], 1), (51, [0.9, 0.1], 1), (52, [0.5, 0.5], 2)]
    assert sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(some, SCHEMA), F.col("vec_id") % 50 == 0).collect())) == plain_negatives(some)
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_and_large_components(spark):
    x = vectors(120, 5, 9) * 200_000
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    want = plain_negatives(rows)
    assert sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect())) == want
    twice = [*rows, *[r for r in rows if r[0] % 50 and r[0] % 5 == 0]]
    assert sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(twice, SCHEMA), F.col("vec_id") % 50 == 0).collect())) == plain_negatives(twice)


def test_the_tree_spares_leaves_and_loses_none():
    x = np.floor(256 * vectors(4000, 6, 1, centers=40)).astype(np.int32)
    tree = negatives.Tree(float((x.astype(np.int64) ** 2).sum(1).max()), 6)
    points = tree.lift(x)
    tree.grow(points[:1000], 8, 50)

    def seen(node, child, d):
        r = tree.ranges[node]
        r[:, child, 0], r[:, child, 1] = np.minimum(r[:, child, 0], d.min(0)), np.maximum(r[:, child, 1], d.max(0))

    leaf = tree.descend(points, seen)
    q = x[::50]
    s = negatives.products(q, x)
    low, high = np.sort(s, 1)[:, -60:-59], np.sort(s, 1)[:, -40:-39]
    distance = lambda v: np.sqrt(np.maximum((q.astype(float) ** 2).sum(1)[:, None] + tree.radius - 2 * v, 0))
    visited = tree.visits(q, distance(high), distance(low))
    for i in range(len(q)):
        inside = (s[i] >= low[i]) & (s[i] <= high[i])
        assert inside.any() and visited[i, leaf[inside]].all()
    assert tree.leaves > 30 and visited.mean() < 0.5
