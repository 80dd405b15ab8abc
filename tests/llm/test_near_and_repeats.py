import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import keep_one_of_near
from tallyspark.llm import common, graphs, minhash, substrings

from .helpers import DOC_SCHEMA, by_id, frame, prose, words


def shingle_bag(text):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def likeness(a, b):
    a, b = shingle_bag(a), shingle_bag(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def classes_brute(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if root(i) != root(j) and likeness(a, b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def edit(text, r, n):
    w = words(text)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(4):
        n = 60
        values = common.mix(np.arange(n, dtype=np.uint64) + np.uint64(rng.integers(1 << 30)))
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
        owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        sig = minhash.bag_minhash(owner, np.concatenate([values[a > 0], values[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / 4096)


def test_signatures_do_not_depend_on_the_chunk():
    texts = [prose(i, 5 + i * 13 % 900) for i in range(60)] + ["one two", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    whole = pa.Table.from_batches(minhash.sketch_batches(iter([batch]), 128, 4)).to_pylist()
    for i in (0, 5, 17, 60, 61):
        assert next(minhash.sketch_batches(iter([batch.slice(i, 1)]), 128, 4)).to_pylist()[0] == whole[i]


def test_components_of_chains_stars_and_pairs(spark, tmp_path):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1300)] + [(r.randrange(5000, 5200), r.randrange(5000, 5200)) for _ in range(90)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}
    scratch = common.Scratch(spark, "test")
    got = graphs.components(spark.createDataFrame(links, "a long, b long"), scratch, "t").collect()
    assert {x.node: x.component for x in got} == want and len(got) == len(want)


def test_near_groups_against_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", " ", "a b", "a b", "a  b c"]
    for k in range(6):
        base = prose(k + 50, 120 + 40 * k)
        texts += [base, edit(base, r, 1), edit(base, r, 2), edit(base, r, 3), base.replace(" ", "\n")]
    # a chain: each text is near the next one only
    chain = prose(900, 200).split(" ")
    for k in range(12):
        texts.append(" ".join(chain[k * 8 : k * 8 + 100]))
    texts += [prose(i + 300, 80) for i in range(20)]
    # many edits of one text, some too far from each other
    base = prose(77, 150)
    texts += [edit(base, r, r.randrange(1, 9)) for _ in range(60)]
    # repeated words weigh
    texts += ["x y z " * 50, "x y z " * 45, "x y z " * 10]
    rows = list(enumerate(texts, 1))
    got = by_id(minhash.near_groups(frame(spark, texts), block=16))
    want = classes_brute(rows)
    assert {i: x.class_id for i, x in got.items()} == want
    sizes = Counter(want.values())
    assert all(x.class_size == sizes[x.class_id] and x.kept == (i == x.class_id) for i, x in got.items())
    assert sorted(x.doc_id for x in minhash.drop_near_copies(frame(spark, texts), block=16).collect()) == sorted(set(want.values()))


def test_near_groups_repeated_and_null_ids(spark):
    a, b = prose(1, 60), prose(2, 60)
    docs = spark.createDataFrame([(7, a, None, None, 1), (7, a, None, None, 1), (9, b, None, None, 1), (7, b, None, None, 1), (None, "lone", None, None, 1)], DOC_SCHEMA)
    got = [(x.doc_id, x.class_id, x.class_size) for x in minhash.near_groups(docs).collect()]
    assert sorted(got, key=str) == sorted([(7, 7, 4), (7, 7, 4), (7, 7, 4), (9, 7, 4), (None, None, 1)], key=str)
    assert minhash.near_groups(docs.limit(0)).count() == 0
    assert minhash.drop_near_copies(docs.where("doc_id is not null")).count() == 1


def test_a_link_of_unlike_signatures_is_found(spark):
    # 8 of 10 shingles are shared, but 81 of 128 components only
    texts = [" ".join(f"s41411x{k}" for k in range(12)) + f" {last}" for last in ("one", "two")]
    assert likeness(*texts) == 0.8
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], ["doc_id", "text"])
    x, y = (np.frombuffer(r["signature"], dtype=np.uint32) for r in pa.Table.from_batches(minhash.sketch_batches(iter([batch]), 128, 4)).to_pylist())
    assert (x == y).sum() == 81
    assert {r.doc_id: r.class_id for r in minhash.near_groups(frame(spark, texts)).collect()} == {1: 1, 2: 1}


def test_no_clean_document_is_dropped_for_its_id(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(7, a), (9, b), (7, b), (None, a + " "), (None, c), (None, c.replace(" ", "  ")), (None, None), (8, prose(4, 60)), (8, prose(5, 60))]
    docs = spark.createDataFrame([(i, t, None, None, k) for k, (i, t) in enumerate(rows)], DOC_SCHEMA)
    kept = minhash.drop_near_copies(docs, by_id=False).collect()
    # a of id 7, b of id 7, one c, the empty text and both texts of id 8
    assert {r.n_chars for r in kept} - {4, 5} == {0, 2, 6, 7, 8} and len(kept) == 6
    # the pipeline's stage keeps as many
    assert sorted(r.n_chars for r in keep_one_of_near(spark, docs, "").collect()) == sorted(r.n_chars for r in kept)
    # rows of one id as one document: a and b are one group, so are the texts of id 8; null ids stay
    one = minhash.drop_near_copies(docs).collect()
    assert sorted(map(str, (r.doc_id for r in one))) == ["7", "8", "None", "None"]
    assert minhash.drop_near_copies(docs.limit(0), by_id=False).count() == minhash.drop_near_copies(docs.limit(0)).count() == 0


def removal_brute(rows, width=35):
    seen = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = words(t)
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])].append((k, i))
    gone = defaultdict(set)
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                gone[k].update(range(i, i + width))
    out = []
    for k, (d, t) in enumerate(rows):
        w = words(t)
        left = " ".join(x for i, x in enumerate(w) if i not in gone[k])
        out.append((d, len(w), len(gone[k]), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def repeat_texts(seed):
    r = random.Random(seed)
    tiny = lambda n, v: " ".join(r.choice(v) for _ in range(n))
    texts = [None, "", "a", "a " * 35, "a " * 36, "a " * 34, "b c " * 40, "b c " * 17 + "b", "d e f " * 30]
    shared = [prose(seed * 31 + i, 30 + i * 3) for i in range(8)]
    for _ in range(30):
        parts = []
        for _ in range(r.randrange(1, 6)):
            parts.append(r.choice(shared) if r.random() < 0.5 else prose(r.randrange(10**9), r.randrange(1, 60)))
        texts.append(" ".join(parts))
    texts += [tiny(r.randrange(30, 120), "ab") for _ in range(25)]
    texts += ["x " * r.randrange(1, 50) + tiny(40, "xy") + " x" * r.randrange(1, 50) for _ in range(15)]
    long = prose(seed + 5, 400)
    texts += [long, long, long + " end", words(long)[3] + " " + long, "\n".join(words(long)[100:180])]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_against_brute_force(spark, seed):
    texts = repeat_texts(seed)
    got = sorted(map(tuple, substrings.remove_repeats(frame(spark, texts)).collect()), key=str)
    assert got == removal_brute(list(enumerate(texts, 1)))


def test_repeats_with_repeated_ids(spark):
    a, b = prose(1, 100), prose(2, 80)
    rows = [(5, a), (5, b), (5, a), (6, " ".join(words(b)[10:60])), (None, prose(3, 50)), (None, " ".join(words(a)[:40]))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=str) == removal_brute(rows)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_every_window_has_an_anchor_that_its_copies_share():
    r = random.Random(8)
    for width in (24, 35):
        for _ in range(40):
            passage = [r.choice("abcde"[: r.randrange(1, 6)]) for _ in range(width)]
            found = set()
            for _ in range(6):
                text = [r.choice("abcde") for _ in range(r.randrange(40))] + passage + [r.choice("abcde") for _ in range(r.randrange(40))]
                at = next(i for i in range(len(text)) if text[i : i + width] == passage)
                c = next(common.chunks(pa.array([" ".join(text)])))
                starts, anchors = substrings.window_anchors(c.hashes(), c.first, width)
                k = int(np.flatnonzero(starts == at)[0])
                found.add((int(anchors[k, 0]) - at, int(anchors[k, 1])))
                assert at + 8 <= anchors[k, 0] < at + width - 8 and anchors[k, 1] != 0
            assert len(found) == 1


def test_only_texts_of_members_are_shuffled(spark):
    rows = spark.range(20000).select("id", F.xxhash64("id").alias("hash"), F.concat(F.lit("t"), "id").alias("text"))
    wanted = rows.where("id % 50 = 3").select("id", "hash")
    got = [r.id for r in minhash.picked(rows, wanted, ["id", "hash"]).collect()]
    assert {i for i in range(20000) if i % 50 == 3} <= set(got) and len(got) == len(set(got)) < 2400
    # a map that is too small loses nothing
    assert {i for i in range(20000) if i % 50 == 3} <= {r.id for r in minhash.picked(rows, wanted, ["id", "hash"], 1 << 10).collect()}
    assert minhash.picked(rows, wanted.limit(0), ["id", "hash"]).count() == 0
    clash = rows.withColumnsRenamed({"hash": "piece", "text": "bit"})
    assert minhash.picked(clash, clash.where("id < 5"), ["id", "piece"]).where("id < 5").select("id", "piece", "bit").count() == 5
