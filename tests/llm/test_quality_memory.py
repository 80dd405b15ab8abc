"""What a task of the quality classifier holds."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import quality

SF = "/root/testdata/sf0.001"


def test_context_tables_are_added_in_little_memory():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 8))) for _ in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(rnd.choices(words, k=400)) for _ in range(2000)])], ["text"])
    tracemalloc.start()
    try:
        (table,) = quality.context_table(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert table.num_rows > 1000 and peak < 90e6


def test_poor_documents_of_texts_that_are_sent_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    good = quality.quality_scores(docs, labels).where("predicted = 1").select("doc_id")
    want = sorted(r.doc_id for r in good.collect())
    kept = quality.drop_poor(docs, labels)
    assert kept.schema.simpleString() == docs.schema.simpleString() and sorted(r.doc_id for r in kept.collect()) == want
    # a text column of another type goes beside its text
    binary = docs.withColumn("text", F.col("text").cast(T.BinaryType()))
    again = quality.drop_poor(binary, labels)
    assert again.schema["text"].dataType == T.BinaryType() and sorted(r.doc_id for r in again.collect()) == want
