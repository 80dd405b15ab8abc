"""Packing of tokenised documents into sequences of bounded length.

A document's ids (its words' ids, then an end id) are cut into full windows of
`capacity`, each a sequence of its own, and a remainder. Remainders are packed best fit
decreasing: longest first, each into the open sequence with the least room that still
holds it, found in a segment tree over the remaining capacities.

The ids are made, cut and check-summed in the one pass that reads the texts; only pieces
(a few integers) are shuffled. They are dealt by a hash of document, start and place to groups
of about `group_pieces`, so that a group fits one task whatever the input's size or its
longest document; each group wastes at most its last open sequences.

Null and empty texts have the end id alone. Repeated rows are packed as often as they
occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, Scratch, chunks, ship

CAPACITY = 2048
END_ID = 1
GROUP_PIECES = 50_000
#: Words whose ids a Python worker remembers.
CACHED_WORDS = 300_000
#: Joins words for the tokenizer; it has an id of its own, and words that contain it are encoded alone.
_MARK = b"\x01"

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of words by a tokenizer that never joins across white space; remembers frequent words.

    White space separates the tokenizer's pieces, so a text's ids are its words' ids in
    turn; each distinct word of a chunk is encoded once. Words are known by a 64-bit hash
    of their bytes (ASCII letters lower-cased, as the tokenizer does itself), which a second
    hash of another seed confirms.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the tokenizer has no id for the mark")
        self.mark = mark[0]
        self.known = np.zeros(0, dtype=np.uint64)  # sorted word hashes
        self.proof = np.zeros(0, dtype=np.uint64)  # their second hashes
        self.at = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        plain = [i for i, w in enumerate(words) if _MARK not in w and b"<|" not in w]
        counts = np.zeros(len(words), dtype=np.int64)
        parts: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(words)
        odd = sorted(set(range(len(words))) - set(plain))
        for i, e in zip(odd, self.tokenizer.encode_batch([words[i].decode("utf-8", "replace") for i in odd], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, dtype=np.uint32)
            counts[i] = len(e.ids)
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            joined = (b" " + _MARK + b" ").join([*(words[i] for i in some), b""]).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            begins = np.concatenate([[0], ends[:-1] + 1])
            for i, a, b in zip(some, begins, ends, strict=True):
                parts[i] = ids[a:b]
            counts[some] = ends - begins
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32), counts

    def chunk_ids(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk in turn (without end ids), and n+1 offsets."""
        unique, sample, inverse = np.unique(chunk.hashes(0, lower=True), return_index=True, return_inverse=True)
        second = chunk.hashes(2, lower=True)
        proof = second[sample]
        if (proof[inverse] != second).any():
            raise ValueError("two words have the same hash")
        place = np.searchsorted(self.known, unique)
        place[place == len(self.known)] = 0
        hit = self.known[place] == unique if len(self.known) else np.zeros(len(unique), dtype=bool)
        if (self.proof[place[hit]] != proof[hit]).any():
            raise ValueError("two words have the same hash")
        fresh = np.flatnonzero(~hit)
        ids, counts = self.encode_words([chunk.word(i) for i in sample[fresh]])
        begin, length = np.zeros(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=np.int64)
        begin[hit], length[hit] = self.at[place[hit]], self.at[place[hit] + 1] - self.at[place[hit]]
        begin[fresh], length[fresh] = len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(fresh) else 0, counts
        pool = np.concatenate([self.ids, ids])
        n = length[inverse]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = pool[np.repeat(begin[inverse] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, dtype=np.uint32)
        if len(self.known) < CACHED_WORDS and len(fresh):
            order = np.argsort(np.concatenate([self.known, unique[fresh]]), kind="stable")
            begins = np.concatenate([self.at[:-1], begin[fresh]])[order]
            lengths = np.concatenate([np.diff(self.at), length[fresh]])[order]
            ends_all = np.cumsum(lengths)
            self.ids = pool[np.repeat(begins - (ends_all - lengths), lengths) + np.arange(int(ends_all[-1]))]
            self.at = np.concatenate([[0], ends_all])
            self.known = np.concatenate([self.known, unique[fresh]])[order]
            self.proof = np.concatenate([self.proof, proof[fresh]])[order]
        return out, np.concatenate([[0], ends])[chunk.first]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of one partition."""
    encode = encoder(path)
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            ids, at = encode.chunk_ids(chunk)
            doc_ids = batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo)
            rows: list[tuple[int, int, int, int, int]] = []
            for i in range(chunk.hi - chunk.lo):
                own = np.append(ids[at[i] : at[i + 1]], end_id).astype("<u4")
                for start in range(0, len(own), capacity):
                    piece = own[start : start + capacity]
                    rows.append((i, start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )


class OpenWindows:
    """Open sequences by room left, in a segment tree whose leaves are the capacities."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.most = [-1] * (2 * self.size)  # largest room with an open sequence below a node
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _update(self, room: int) -> None:
        node = room + self.size
        self.most[node] = room if self.open[room] else -1
        node //= 2
        while node:
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])
            node //= 2

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        if len(self.open[room]) == 1:
            self._update(room)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least `need`: (room, window)."""
        if self.most[1] < need:
            return None
        node, low, width = 1, 0, self.size
        while width > 1:
            width //= 2
            # the left half holds the smaller rooms: go there if any of its open ones is large enough
            if self.most[2 * node] >= need:
                node = 2 * node
            else:
                node, low = 2 * node + 1, low + width
        window = self.open[low].pop()
        if not self.open[low]:
            self._update(low)
        return low, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length; lengths are taken longest first, equal ones in turn."""
    window, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, opened = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = tree.tightest(need)
        if found is None:
            room, own = capacity, opened
            opened += 1
        else:
            room, own = found
        window[i], offset[i] = own, capacity - room
        if room > need:
            tree.add(room - need, own)
    return window, offset


def pack_group(key: tuple, group: pa.Table, capacity: int) -> pa.Table:
    group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "place")]).drop_columns(["place"])
    window, offset = best_fit_decreasing(group.column("length").to_numpy(), capacity)
    used = np.bincount(window, weights=group.column("length").to_numpy()).astype(np.int64)
    pad = np.where((used & (used - 1)) == 0, 0, capacity - used)
    own = (int(key[0].as_py()) << 32) + window
    return group.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(own)).append_column("offset", pa.array(offset)).append_column("sequence_padding", pa.array(pad[window]))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: piece_batches(it, tokenizer_path, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: the columns of token_pieces, and sequence_id, offset, sequence_padding."""
    scratch = Scratch(docs.sparkSession, "packing")
    # a piece's place among the written ones deals out equal rows, too
    pieces = scratch.keep(token_pieces(docs, tokenizer_path, capacity, end_id).withColumn("place", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(
        lambda key, group: pack_group(key, group, capacity),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_padding long",
    )
