import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import common, exact, mixing, packing
from tallyspark.llm.queries import queries, tokenizer_path

from .helpers import DOC_SCHEMA, SPACES, by_id, documents, frame, prose, words

SF = "/root/testdata/sf0.01"


def test_chunks_find_words_and_hash_them_alike():
    texts = ["  a b\tc", None, "", "a\x0bé\xa0x \x1c", " ", "c" * 3000, "b"]
    seen = {}
    for size in (4, 1 << 20):
        found = []
        for c in common.chunks(pa.array(texts), size):
            h = c.hashes()
            for i in range(c.hi - c.lo):
                own = [c.word(j).decode() for j in range(c.first[i], c.first[i + 1])]
                assert own == words(texts[c.lo + i])
                found += own
                for w, x in zip(own, h[c.first[i] : c.first[i + 1]], strict=True):
                    assert seen.setdefault(w, x) == x
        assert found == [w for t in texts for w in words(t)]
    assert len(set(seen.values())) == len(seen)


def exact_brute(rows):
    sha = {i: hashlib.sha256(SPACES.sub(" ", t or "").encode()).hexdigest() for i, t in rows}
    groups = defaultdict(list)
    for i, s in sha.items():
        groups[s].append(i)
    return {i: (min(groups[s]), len(groups[s]), i == min(groups[s]), s) for i, s in sha.items()}


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_groups_against_brute_force(spark, counters):
    texts = ["a b", "a  b", "a\tb\n", None, "", " ", *["hot text"] * 40, *(prose(i % 7, 30) for i in range(20)), prose(1, 30_000), prose(1, 30_000)]
    docs = frame(spark, texts)
    want = exact_brute(list(enumerate(texts, 1)))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs, counters).collect()}
    assert got == want
    left = exact.drop_copies(docs.withColumn("keep_id", docs.lang), counters)
    assert left.columns == [*docs.columns, "keep_id"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, x in want.items() if x[2])


def test_exact_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "x", None, None, None), (1, "x", None, None, None), (None, "x", None, None, None), (None, "y", None, None, None)], DOC_SCHEMA)
    assert sorted(exact.exact_groups(docs).select("keep_id", "group_size", "kept").collect(), key=str) == sorted([(1, 3, True), (1, 3, True), (1, 3, False), (None, 1, True)], key=str)
    assert sorted((r.doc_id or 0, r.text) for r in exact.drop_copies(docs).collect()) == [(0, "y"), (1, "x")]
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_misra_gries_bound():
    values = ["a"] * 500 + [f"x{i}" for i in range(1500)] + ["b"] * 300
    rng = np.random.default_rng(1)
    rng.shuffle(values)
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 97])], ["d"]) for i in range(0, len(values), 97)]
    out = next(exact.frequent_counts(iter(batches), 10)).to_pydict()
    held = dict(zip(out["text_sha256"], out["seen"], strict=True))
    assert len(held) <= 10
    for x, n in Counter(values).items():
        assert n - len(values) / 11 <= held.get(x, 0) <= n


def test_best_fit_takes_the_tightest_window():
    lengths = np.array([9, 6, 5, 4, 4, 1, 1])
    window, offset = packing.best_fit_decreasing(lengths, 10)
    # the last two lengths find windows 0 and 2 with room for one each; either order is right
    assert window[:5].tolist() == [0, 1, 2, 1, 2] and sorted(window[5:].tolist()) == [0, 2]
    assert offset.tolist() == [0, 0, 0, 6, 5, 9, 9]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2049, 3000)
    window, offset = packing.best_fit_decreasing(lengths, 2048)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):  # plain search for the tightest
        fits = [(r, k) for k, r in enumerate(rooms) if r >= lengths[i]]
        if fits:
            rooms[min(fits)[1]] -= lengths[i]
        else:
            rooms.append(2048 - lengths[i])
    assert window.max() + 1 == len(rooms)
    assert sorted(2048 - np.bincount(window, weights=lengths)) == sorted(rooms)


def check_packing(docs, rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_query_round_trip(spark):
    docs = documents(spark).collect()
    rows = queries()["op2_packing"](spark, SF).collect()
    check_packing(docs, rows, 2048)
    used = sum(r.length for r in rows)
    assert used / (2048 * len({r.sequence_id for r in rows})) > 0.99


def test_packing_awkward_texts(spark):
    texts = [None, "", " \n", "It's <|endoftext|> we'll \x01 x", "a\x01b <| |>", "İstanbul Σς É é  x", "word " * 5000, prose(1, 40), prose(1, 40)]
    docs = frame(spark, texts)
    check_packing(docs.collect(), packing.pack(docs, tokenizer_path(), 64, group_pieces=50).collect(), 64)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def fill(sizes, weights, total):
    """Targets by resharing the excess again and again."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > 2 * sizes[i] + 1e-9}
        if not over:
            for i in free:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = 2.0 * sizes[i]
        left -= sum(targets[i] for i in over)
        free -= over
    return targets


def test_targets_against_resharing():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = [int(x) for x in rng.pareto(1, 21) * 100]
        weights = [(3, 1, 2)[i % 3] for i in range(21)]
        assert mixing.target_words(sizes, weights) == pytest.approx(fill(sizes, weights, 1.5 * sum(sizes)))


def test_flow_is_cheapest_on_small_networks():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(30):
        patterns = [((0,), int(rng.integers(1, 4))), ((0, 1), int(rng.integers(1, 4))), ((1,), int(rng.integers(1, 4)))]
        targets = [int(rng.integers(0, 7)), int(rng.integers(0, 7))]
        got = mixing.route(patterns, targets, 2)
        best = None
        for a, b0, b1, c in product(range(7), repeat=4):
            w = [x for _, x in patterns]
            if a <= 2 * w[0] and b0 + b1 <= 2 * w[1] and c <= 2 * w[2] and a + b0 <= targets[0] and b1 + c <= targets[1]:
                score = (-(a + b0 + b1 + c), sum(max(0, x - y) for x, y in zip((a, b0 + b1, c), w, strict=True)))
                best = score if best is None else min(best, score)
        assert (-sum(map(sum, got)), sum(x[1] for x in got)) == best
        assert all(x[1] == 0 or x[0] == w for x, (_, w) in zip(got, patterns, strict=True))


def check_mix(rows, docs):
    size = {d.doc_id: len(words(d.text)) for d in docs}
    names = sorted({d.source for d in docs}, key=lambda x: (x is None, x or ""))
    sizes = [sum(size[d.doc_id] for d in docs if d.source == n) for n in names]
    targets = dict(zip(names, fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes)), strict=True))
    for d in docs:
        r = rows[d.doc_id]
        assert r["size"] == size[d.doc_id] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(targets[d.source]) and r.source_size == sizes[names.index(d.source)]
    for n in names:
        assert abs(sum(rows[d.doc_id].taken for d in docs if d.source == n) - targets[n]) <= 1


def test_mixing_query(spark):
    rows = by_id(queries()["op10_mixing"](spark, SF))
    check_mix(rows, documents(spark).collect())
    assert rows == by_id(queries()["op10_mixing"](spark, SF))


def test_mixing_awkward_rows(spark):
    texts = [None, "", "  one ", *[prose(i, 1 + i * 7 % 90) for i in range(60)]]
    docs = frame(spark, texts, sources=[None, "b", "b", *[[None, "a", "b", "c"][i * i % 4] for i in range(60)]])
    rows = by_id(mixing.mix_sources(docs))
    check_mix(rows, docs.collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == Counter({i: r.taken for i, r in rows.items() if r.taken})
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_overlapping_sources(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, [prose(i, 50) for i in range(90)]).withColumn("of", F.expr("case doc_id % 3 when 0 then array('a') when 1 then array('b','a') else array('b') end"))
    out = mixing.mix_sources(docs, members=F.col("of"), weights=(1,), share=0.5).collect()
    assert sum(r.taken for r in out) == pytest.approx(0.5 * 90 * 50, abs=2)
    assert all(r.taken <= r["size"] for r in out)
