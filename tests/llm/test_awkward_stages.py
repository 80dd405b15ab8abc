"""Every stage of the pipeline, and the operators' counts, on awkward rows against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyspark.llm import common, fingerprints, minhash, pii, quality, substrings
from tallyspark.llm.queries import tokenizer_path

from .helpers import DOC_SCHEMA, SPACES, frame, prose, words
from .test_exact_packing_mixing import fill
from .test_near_and_repeats import classes_brute, edit, removal_brute
from .test_text_operators import check_fingerprints

#: Names that helper columns have or had, and one with a dot.
CLASHES = (
    "_row", "_order", "_class", "_rows", "_kept_id", "_kept_sha", "_words", "_size", "_quality_text", "row_number", "Row_Number_", "kept_id", "kept_sha", "kept_rows",
    "mix_size", "mix_words", "quality_text", "class", "node", "component", "key", "part", "hash", "text_sha256", "taken", "size", "score", "a.b",
)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    a, b, c, d = prose(1, 80), prose(2, 80), prose(3, 80), prose(4, 90)
    texts = [
        (7, a, "s1"), (9, b, "s1"), (7, b + " x", "s2"), (None, a.replace(" ", "\n"), "s1"), (None, c, None), (None, c, None), (8, d, "s2"), (8, prose(5, 60), "s3"), (11, edit(d, r, 1), "s2"),
        (12, None, "s1"), (13, "", "s2"), (None, " \t", None), (14, "one", "s3"), (14, "one", "s3"), (15, prose(6, 30_000), "s4"), (16, "é 日本 🙂", "s1"), (2, c + "  ", "s1"),
    ]
    return [(i, t, s, k) for k, (i, t, s) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    base = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s, _ in rows], DOC_SCHEMA)
    numbers = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), k) for i, t, s, k in rows], DOC_SCHEMA + ", k long")
    assert base.count() == numbers.count()
    return numbers.select(*base.columns, *[F.col("k").alias(n) for n in CLASHES])


def kept(out, docs):
    """Numbers of the rows that are left; no other column has changed."""
    assert out.columns == docs.columns
    found = [tuple(r) for r in out.collect()]
    assert all(len(set(r[5:])) == 1 for r in found)
    return [r[5] for r in found]


def first_of(rows, members):
    """The row that stays of some: the smallest id, null ids last. Rows that are equal in id and text count alike."""
    return min(members, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))


def same_rows(rows, got, want):
    own = lambda ks: sorted(((rows[k][0], rows[k][1]) for k in ks), key=str)
    assert own(got) == own(want)


def test_quality_stage(spark, rows, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in (2, 7, 8, 9, 11, 14, 15, 16)], "doc_id long, quality int")
    scores = quality.quality_scores(docs, labels).collect()
    of_text = {}
    for r, (_, t, _, _) in zip(scores, rows, strict=True):
        assert of_text.setdefault(t or "", r.score) == r.score
    same_rows(rows, kept(quality.drop_poor(docs, labels), docs), [k for _, t, _, k in rows if of_text[t or ""] >= quality.THRESHOLD])
    assert kept(quality.drop_poor(docs.limit(0), labels), docs) == []


def test_exact_stage(spark, rows, docs):
    groups = defaultdict(list)
    for _, t, _, k in rows:
        groups[SPACES.sub(" ", t or "")].append(k)
    same_rows(rows, kept(corpus_pipeline.keep_first_copies(spark, docs, ""), docs), [first_of(rows, ks) for ks in groups.values()])
    assert kept(corpus_pipeline.keep_first_copies(spark, docs.limit(0), ""), docs) == []


def test_near_stage(spark, rows, docs):
    classes = defaultdict(list)
    for k, c in classes_brute([(k, t) for _, t, _, k in rows]).items():
        classes[c].append(k)
    got = kept(corpus_pipeline.keep_one_of_near(spark, docs, ""), docs)
    assert len(got) == len(classes)
    assert all(len([k for k in ks if k in got]) == 1 and (rows[next(k for k in ks if k in got)][0] is None) == all(rows[k][0] is None for k in ks) for ks in classes.values())
    assert kept(corpus_pipeline.keep_one_of_near(spark, docs.limit(0), ""), docs) == []


def test_mixing_stage(spark, rows, docs):
    out = corpus_pipeline.mix_to_targets(spark, docs, "")
    got = kept(out, docs)
    size = {k: len(words(t)) for _, t, _, k in rows}
    names = sorted({s for _, _, s, _ in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(size[k] for _, _, s, k in rows if s == n) for n in names]
    targets = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    taken = Counter()
    for r in out.collect():
        k = r[5]
        taken[rows[k][2]] += len(words(r.text))
        assert words(r.text) == words(rows[k][1])[: len(words(r.text))] and r.n_chars == len(r.text)
    assert all(abs(taken[n] - t) <= 1 for n, t in zip(names, targets, strict=True))
    assert max(Counter(got).values()) <= 2
    again = lambda: sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_to_targets(spark, docs, "").collect()), key=str)
    assert again() == again()
    assert kept(corpus_pipeline.mix_to_targets(spark, docs.limit(0), ""), docs) == []


def test_packing_stage(spark, rows, docs):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, _, _ in rows:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in corpus_pipeline.pack_sequences(spark, docs, "").collect():
        got[r.doc_id] += r.length
    assert got == want


def test_a_large_cluster_sends_few_rows(spark, monkeypatch):
    # near copies of one text, and texts that are linked to some of them only
    r = random.Random(3)
    base = prose(40, 300)
    texts = [edit(base, r, r.randrange(1, 4)) for _ in range(900)] + [edit(base, r, 7) for _ in range(30)]
    sent, keep, blocks = [], common.Scratch.keep, minhash.in_blocks

    def counting(self, df, name):
        out = keep(self, df, name)
        if name == "texts":
            sent.append(out.agg(F.sum(F.size("own"))).first()[0])
        return out

    def dealing(members):
        out = blocks(members)
        if "text" in members.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "keep", counting)
    monkeypatch.setattr(minhash, "in_blocks", dealing)
    got = {x.doc_id: x.class_id for x in minhash.near_groups(frame(spark, texts)).collect()}
    assert len(sent) == 2 and sum(sent) <= 3 * len(texts)
    monkeypatch.undo()
    assert got == classes_brute(list(enumerate(texts, 1)))


def test_near_groups_of_long_and_short_texts(spark):
    r = random.Random(9)
    long = prose(11, 30_000)
    texts = [long, edit(long, r, 20), "a b c d", "a b c d", prose(12, 6), long + " " + prose(13, 9_000)]
    got = {x.doc_id: x.class_id for x in minhash.near_groups(frame(spark, texts), block=2, block_bytes=1000).collect()}
    assert got == classes_brute(list(enumerate(texts, 1)))


@pytest.mark.parametrize("per_range", [2, 1000])
def test_fingerprints_of_null_and_repeated_ids(spark, per_range):
    rows = [(None, "n one two three"), (None, "n four five six seven"), (3, "a b c d e f"), (3, "g h i j k l m n"), (3, "a b c d e f"), (4, prose(2, 20_000)), (0, "zero zero"), (None, "zero zero"), (9, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)
    got = fingerprints.edited_fingerprints(docs, per_range).collect()
    # in the operator's own order of ids and text hashes, documents are an ordinary table
    hashes = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, ~hashes[x[1] or ""] if x[0] is None else hashes[x[1] or ""]))
    plain = {tuple(r)[1:] for r in fingerprints.edited_fingerprints(frame(spark, [t for _, t in order])).collect()}
    assert {tuple(r)[1:] for r in got} == plain and Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    check_fingerprints(list(enumerate((t for _, t in order), 1)), {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, [t for _, t in order])).collect()})


@pytest.mark.parametrize("block", [2, 1024])
def test_near_fingerprints_in_blocks(spark, block):
    r = random.Random(1)
    base = r.getrandbits(128)
    prints = {base ^ (1 << r.randrange(100, 128)) ^ (1 << r.randrange(90, 128)) for _ in range(60)} | {r.getrandbits(128) for _ in range(20)}
    names = [f"{x:032x}" for x in prints]
    want = sorted((a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in names for b in names if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3)
    got = fingerprints.near_fingerprints(spark.createDataFrame([(x,) for x in names], "fingerprint string"), 3, block=block).collect()
    assert sorted(map(tuple, got)) == want


def test_near_prints_are_counted(spark):
    texts = [prose(7, 400), prose(7, 400) + " z", prose(8, 50), prose(8, 50), prose(9, 60)]
    got = fingerprints.edited_fingerprints(frame(spark, texts)).collect()
    distinct = {r.fingerprint for r in got}
    for r in got:
        assert r.near_prints == sum(x != r.fingerprint and (int(x, 16) ^ int(r.fingerprint, 16)).bit_count() <= 3 for x in distinct)


TOKEN = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^\x20\x09-\x0DA-Za-z0-9\u0080-\U0010ffff]+")
CUE = re.compile(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(pii.CUES) + r")[\"']?[ \t]{0,3}[=:]")


def told_brute(texts, support):
    """(share, bits) of each term and shape, by plain counting."""
    holds, together, contexts, documents = Counter(), Counter(), defaultdict(set), Counter()
    for text in texts:
        tokens = [(m.start(), m.end(), m.group().lower()) for m in TOKEN.finditer(text or "")]
        names = lambda w: [w] + ([len(w.encode())] if len(w.encode()) >= 16 and any(c.isdigit() for c in w) and not w.isdigit() else [])
        is_term = lambda w: w[0].isalnum() and len(w.encode()) >= 4
        for t in {t for _, _, w in tokens if is_term(w) for t in names(w)}:
            documents[t] += 1
        marks = [(a, b, e) for a, k, b in pii.base_spans(text or "") for e in pii.entities_of(k, text[a:b])]
        marks += [(m.start(), m.end(), "secret") for m in CUE.finditer(text or "")]
        free = [is_term(w) and not any(s < b and e > a for a, b, _ in marks) for s, e, w in tokens]
        pairs = {}
        for a, b, e in marks:
            x = next((i for i, t in enumerate(tokens) if t[0] >= a), len(tokens))
            y = next((i for i, t in enumerate(tokens) if t[0] >= b), len(tokens))
            near = [tokens[i][2] for i in range(max(0, x - 12), min(len(tokens), y + 12)) if free[i]]
            for t in {t for w in near for t in names(w)}:
                pairs.setdefault((e, t), set()).add(tuple(sorted(near)))
        holds.update({e for _, _, e in marks})
        for p, seen in pairs.items():
            together[p] += 1
            contexts[p].add(frozenset(seen))
    out = {}
    for (e, t), n in together.items():
        if len(contexts[e, t]) >= support:
            share = n / documents[t]
            old = out.get(t, (0.0, -math.inf))
            out[t] = (max(old[0], share), max(old[1], math.log2(share * len(texts) / holds[e])))
    return out


def test_shares_and_bits_against_plain_counting(spark):
    r = random.Random(6)
    names = ["Anna", "Zorblatt", "Quux7", "mueller", "größe"]
    some = lambda n: " ".join(f"word{r.randrange(60)}" for _ in range(n))
    texts = [some(30) for _ in range(120)]
    texts += [f"{some(9)} {r.choice(names)} mails {r.choice('abc')}@{r.choice('xy')}corp.example {some(14)}" for _ in range(60)]
    texts += [f"{some(9)} token = \"{r.getrandbits(160):040x}\" {some(9)}" for _ in range(12)]
    texts += [f"commit {r.getrandbits(160):040x} {r.choice(names)} {some(20)}" for _ in range(3)] + [None, ""]
    want = told_brute(texts, 3)
    got = pii.disclosing_terms(frame(spark, texts), common.Scratch(spark, "test"), share=0.0, bits=-99.0).collect()
    mix = lambda n: int(common.as_long(common.mix(np.array([n], dtype=np.uint64) ^ pii._SHAPE))[0])
    name = lambda t: mix(t) if isinstance(t, int) else int(common.as_long(next(common.chunks(pa.array([t]), kinds=pii.TERMS)).hashes(5, lower=True))[0])
    assert len(want) > 50 and 40 in want and {x.term: (round(x.share, 9), round(x.bits, 9)) for x in got} == {name(t): (round(s, 9), round(b, 9)) for t, (s, b) in want.items()}
    marked = {x.doc_id: x for x in pii.private_spans(frame(spark, texts), bits=3.0, texts=True).collect()}
    secrets = [m for m in marked.values() if "token =" in (texts[m.doc_id - 1] or "")]
    assert len(secrets) == 12 and all(m.n_term >= 1 and m.n_spans >= m.n_term and not re.search("[0-9a-f]{40}", m.sanitised) for m in secrets)


def test_long_texts_have_all_their_spans(spark):
    long = prose(3, 40_000)
    text = f"a@b.co {long} 10.1.2.3 {long} +1 (555) 010-9999"
    r = pii.private_spans(frame(spark, [text, long])).orderBy("doc_id").collect()
    assert (r[0].n_email, r[0].n_ip, r[0].n_phone, r[0].n_spans) == (1, 1, 1, 3) and r[1].n_spans == 0


@pytest.mark.parametrize("heavy", [1, 3, 1024])
def test_repeats_with_heavy_names(spark, heavy):
    shared = prose(1, 60)
    texts = [f"{prose(i + 10, i % 40)} {shared} {prose(i + 90, i % 30)}" for i in range(60)] + ["x " * 90] * 3 + [prose(5, 20_000), prose(5, 20_000) + " end", None, ""]
    got = sorted(map(tuple, substrings.remove_repeats(frame(spark, texts), heavy=heavy).collect()), key=str)
    assert got == removal_brute(list(enumerate(texts, 1)))


def test_context_sums_against_plain_counting():
    texts = ["The cat the cat sat.", "a b c d 12 34 a", None, "", "Über den über", "x"]
    place, sign = quality.index_vectors()
    table = np.zeros((quality.SLOTS, quality.DIMENSIONS))
    for t in texts:
        for c in common.chunks(pa.array([t], pa.string()), kinds=common.TOKENS):
            w, s = quality.token_slots(c)
            for i in range(len(w)):
                for j in range(max(0, i - quality.WINDOW), min(len(w), i + quality.WINDOW + 1)):
                    near = [(w[i], s[i]), (s[i], w[i])] if i == j else [(w[i], w[j]), (w[i], s[j]), (s[i], s[j])]
                    for a, b in near:
                        for k in range(quality.NONZERO):
                            table[a, place[b, k]] += sign[b, k]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    counted = pa.Table.from_batches(quality.context_table(iter([batch])))
    got = {r[0]: r[1:] for r in zip(*(c.to_pylist() for c in counted.columns), strict=True)}
    used = {int(i) for i in np.flatnonzero(np.abs(table).sum(axis=1))}
    assert used <= set(got)
    for slot, sums in got.items():
        assert list(sums) == table[slot].tolist()
