"""Very long texts with very many spans, records that hold version lines, and payloads that many pages share."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyspark.llm import common, pii, warc


def test_marking_is_linear_in_the_hits():
    text = "jane@site.example secretword 10.0.0.1 " * 100_000
    (c,) = common.chunks(pa.array([text]), kinds=pii.TERMS)
    hit = np.flatnonzero(c.stop - c.start >= 4)
    began = time.process_time()
    got = pii.spans_of(c, 0, text, hit)
    assert time.process_time() - began < 15
    words = [text[s:e] for s, k, e in got if k == 4]
    assert len(words) == 100_000 and set(words) == {"secretword"} and sum(k == 0 for _, k, _ in got) == 100_000


def test_terms_beside_base_spans():
    text = "ab@cd.example abcd 4111 1111 1111 1111x wxyz +1 555 0100 200 efgh"
    (c,) = common.chunks(pa.array([text]), kinds=pii.TERMS)
    hit = np.arange(len(c.start))
    base = pii.base_spans(text)
    place = pii.byte_places(c, 0)
    want = sorted([*base, *[(s, 4, e) for s, e in zip(np.searchsorted(place, c.start), np.searchsorted(place, c.stop), strict=True) if not any(s < y and e > x for x, _, y in base)]])
    assert base and pii.spans_of(c, 0, text, hit) == want


def test_records_are_read_in_one_pass():
    lines = warc.VERSION.encode() * 600_000  # 6 MB and more of version lines
    head = f"WARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: {len(lines) + 2}\r\n\r\n".encode()
    stream = head + b"x\r" + lines
    parts = (warc.VERSION.encode() + stream + b"\r\n\r\n" + warc.VERSION.encode() + b"WARC-Type: metadata\r\nContent-Length: 1\r\n\r\ny\r\n\r\n").split(warc.VERSION.encode())
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(parts)), pa.array(parts, pa.binary())], ["file", "value"])
    began = time.process_time()
    got = [r for b in warc.parse_records(iter([batch])) for r in b.to_pylist()]
    assert time.process_time() - began < 15
    assert [r["kind"] for r in got] == ["response", "metadata"] and got[1]["payload"] == b"y"


def test_a_payload_of_very_many_pages(spark):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("x" * 1200)).otherwise(F.concat(F.repeat(F.lit("y"), F.lit(1000)), F.col("id").cast("string"))).alias("html"))
    got = {r.page_id: r.refers_to for r in warc.captures(rows).select("page_id", "refers_to").collect()}
    assert got == {i: 2997 if i % 3 == 0 and i != 2997 else None for i in range(3000)}
