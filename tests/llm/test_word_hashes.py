"""Words that collide under polynomial hashes, and many equal rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import common, minhash, packing, substrings
from tallyspark.llm.queries import tokenizer_path

from .helpers import by_id, frame, words


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


SIZES = (64, 512, 1024, 2048, 4096)


@pytest.mark.parametrize("seed", [0, 1, 2, 5, 11])
def test_complementary_words_differ(seed):
    texts = [thue_morse(n, *ab) for n in SIZES for ab in ("ab", "ba")]
    (c,) = common.chunks(pa.array([" ".join(texts)]))
    assert len(set(c.hashes(seed).tolist())) == len(texts)


def test_a_words_hash_is_its_own():
    """Whatever stands beside it, also words of several blocks."""
    texts = ["a", "bb", "x" * 15, "y" * 16, "z" * 17, thue_morse(100), "é" * 40]
    (c,) = common.chunks(pa.array([" ".join(texts)]))
    alone = [int(h) for t in texts for x in common.chunks(pa.array([t])) for h in x.hashes(3)]
    assert c.hashes(3).tolist() == alone and len(set(alone)) == len(texts)
    assert c.hashes(3, lower=True).tolist() == alone
    (upper,) = common.chunks(pa.array([" ".join(t.replace("a", "A") for t in texts)]))
    assert upper.hashes(3, lower=True).tolist() == alone and upper.hashes(3).tolist() != alone


def test_ids_are_the_tokenizers(spark):
    texts = [thue_morse(n, *ab) for n in SIZES for ab in ("ab", "ba")]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(frame(spark, texts), tokenizer_path(), capacity=8192)
    for doc_id, r in by_id(got).items():
        ids = [*tokenizer.encode(texts[doc_id - 1], add_special_tokens=False).ids, 1]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


def test_unlike_documents_stay_apart(spark):
    shared = " ".join(f"w{i}" for i in range(34))
    texts = [f"{shared} {thue_morse(n, *ab)}" for n in SIZES[1:] for ab in ("ab", "ba")]
    got = by_id(minhash.near_groups(frame(spark, texts), least=0.95))
    assert len({r.class_id for r in got.values()}) == len(texts)


def test_nothing_repeated_nothing_removed(spark):
    shared = " ".join(f"w{i}" for i in range(34))
    texts = [f"{shared} {thue_morse(n, *ab)}" for n in SIZES[1:] for ab in ("ab", "ba")]
    # sequences of two words that collide under a polynomial over words
    texts += [" ".join(thue_morse(2048, *ab)) for ab in ("pq", "qp")]
    got = by_id(substrings.remove_repeats(frame(spark, texts)))
    for i in range(len(SIZES[1:]) * 2):
        assert got[i + 1].n_removed == 0
        assert got[i + 1].kept_sha256 == hashlib.sha256(" ".join(words(texts[i])).encode()).hexdigest()
    starts = Counter(tuple(own[i : i + 35]) for own in map(words, texts) for i in range(len(own) - 34))
    for i, own in enumerate(map(words, texts)):
        gone = {i + j for i in range(len(own) - 34) if starts[tuple(own[i : i + 35])] > 1 for j in range(35)}
        assert got[i + 1].n_removed == len(gone)


def test_equal_rows_are_dealt_to_groups(spark):
    rows = frame(spark, ["the same text"]).crossJoin(spark.range(30_000).select()).drop("n")
    got = packing.pack(rows, tokenizer_path(), group_pieces=1000).collect()
    sizes = {}
    for r in got:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert len(got) == 30_000 and len(sizes) == 30 and max(sizes.values()) < 1300
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (t, p, _) in zip(places, places[1:], strict=False):
        assert p == (o + n if s == t else 0)
