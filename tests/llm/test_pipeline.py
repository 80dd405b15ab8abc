"""Each stage of the corpus pipeline against brute force on a small table."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from tallyspark.llm import quality
from tallyspark.llm.queries import tokenizer_path, training_labels

from .helpers import words
from .test_exact_packing_mixing import exact_brute, fill
from .test_near_and_repeats import classes_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((name, docs.collect()))
        assert name == "packing" or docs.columns == columns
    assert [n for n, _ in seen] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    good, exact, near, mixed, packed = (rows for _, rows in seen)

    source = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.quality_scores(source, training_labels(spark, SF)).collect()}
    assert sorted(r.doc_id for r in good) == sorted(i for i, s in scores.items() if s >= 0.3)
    text = {r.doc_id: r.text for r in source.collect()}
    assert all(r.text == text[r.doc_id] for r in (*good, *exact, *near))

    kept = exact_brute([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in exact) == sorted(i for i, x in kept.items() if x[2])
    classes = classes_brute([(r.doc_id, r.text) for r in sorted(exact)])
    assert sorted(r.doc_id for r in near) == sorted(set(classes.values()))

    names = sorted({r.source for r in near}, key=lambda x: (x is None, x or ""))
    sizes = [sum(len(words(r.text)) for r in near if r.source == n) for n in names]
    targets = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    for n, t in zip(names, targets, strict=True):
        assert abs(sum(len(words(r.text)) for r in mixed if r.source == n) - t) <= 1
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2

    # every copy of every mixed document is packed with all its ids
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want


def test_run_is_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert rows and max(used.values()) <= 2048
