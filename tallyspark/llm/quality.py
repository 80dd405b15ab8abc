"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Tokens are runs of letters, digits or signs. Each has a word (a hash of its lower-case
   form, in one of WORD_SLOTS slots, so the vocabulary is bounded) and a shape (kind, case,
   length, whether it repeats the token before), a word of a second small vocabulary.
2. Random indexing: each word has a fixed sparse ternary index vector, drawn from its hash.
   A word's vector is the sum of the index vectors of the words and shapes within WINDOW
   places of its occurrences in all documents. Every task adds up its own table of
   slots x DIMENSIONS integers; the tables are added by slot. The sum, of a fixed size,
   is centred and scaled to unit length.
3. A document is the mean of its tokens' word vectors, the mean over its distinct words,
   the mean of its tokens' shape vectors and its log length.
4. A network with one hidden layer is fitted by numpy on at most `sample` labelled
   documents (those with the smallest hashes of their ids), and a temperature on a tenth of them.
   The sample is the only bounded part; corpus counts and scores cover all documents.

Only texts and labels of documents given for training are used. Null and empty texts have
zero vectors and are scored like others. Without labels all scores are 0.5; with labels of
one class only, scores are that class's smoothed share. Labels other than 0 and 1 and null
ids are ignored; a document with several labels counts with each. Repeated rows are scored
as often as they occur; an empty table gives an empty result. `drop_poor` passes other
columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DIGITS, LETTERS, TOKENS, Chunk, chunks, mix, ship

DIMENSIONS = 64
WORD_SLOTS = 8192
SHAPE_SLOTS = 256
SLOTS = WORD_SLOTS + SHAPE_SLOTS
NONZERO = 4
WINDOW = 2
SAMPLE = 20_000
HIDDEN = 48
THRESHOLD = 0.3
#: Texts are cut smaller here, as each distinct token of a document has a vector for a while, and each token a dozen neighbours.
_CHUNK = 1 << 18


def token_slots(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape slots of the tokens of a chunk."""
    h = c.hashes(11, lower=True)
    if not len(h):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    head = c.data[c.start]
    kind = TOKENS[head].astype(np.int64)
    length = c.stop - c.start
    upper = (head >= 65) & (head <= 90)
    second = c.data[np.minimum(c.start + 1, len(c.data) - 1)]
    capitals = upper & (length > 1) & (second >= 65) & (second <= 90)
    last = h.copy()
    last[1:] = h[:-1]
    begin = c.first[:-1][np.diff(c.first) > 0]
    last[begin] = ~h[begin]  # a text's first token repeats nothing
    repeated = (h == last) & (kind == LETTERS)
    case = np.where(capitals, 2, upper.astype(np.int64))
    size = np.minimum(np.int64(15), length)
    shape = np.where(kind == LETTERS, case * 32 + repeated * 16 + size, np.where(kind == DIGITS, 96 + size, 112 + (head & 127)))
    return (h % np.uint64(WORD_SLOTS)).astype(np.int64), WORD_SLOTS + np.minimum(shape, SHAPE_SLOTS - 1)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of the slots' index vectors."""
    draws = mix(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(0x1D5)).reshape(SLOTS, NONZERO)
    return (draws >> np.uint64(8)).astype(np.int64) % DIMENSIONS, np.where(draws & np.uint64(1), 1, -1)


def context_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one partition: slot and DIMENSIONS integers."""
    place, sign = index_vectors()
    table = np.zeros(SLOTS * DIMENSIONS, dtype=np.int64)
    seen = np.zeros(SLOTS, dtype=np.int64)

    def add(to: np.ndarray, of: np.ndarray) -> None:
        # slot pairs that occur often are added once with their number; SLOTS squared has 27 bits
        to *= np.int32(SLOTS)
        to += of
        pairs, n = np.unique(to, return_counts=True)
        pairs = pairs.astype(np.int64)
        a, b = pairs // SLOTS, pairs % SLOTS
        for k in range(NONZERO):
            table[:] += np.bincount(a * DIMENSIONS + place[b, k], weights=n * sign[b, k], minlength=len(table)).astype(np.int64)

    for batch in batches:
        for c in chunks(batch.column("text"), 2 * _CHUNK, TOKENS):
            words, shapes = (s.astype(np.int32) for s in token_slots(c))
            seen += np.bincount(words, minlength=SLOTS) + np.bincount(shapes, minlength=SLOTS)
            doc = np.repeat(np.arange(c.hi - c.lo), np.diff(c.first))
            to, of = [words, shapes], [shapes, words]
            for gap in range(1, WINDOW + 1):
                same = doc[gap:] == doc[:-gap]
                for a, b in ((words, words), (words, shapes), (shapes, shapes)):
                    to += [a[gap:][same], a[:-gap][same]]
                    of += [b[:-gap][same], b[gap:][same]]
            add(np.concatenate(to), np.concatenate(of))
    used = np.flatnonzero(seen)
    rows = table.reshape(SLOTS, DIMENSIONS)[used]
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[:, d]) for d in range(DIMENSIONS))], ["slot", *(f"d{d}" for d in range(DIMENSIONS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """SLOTS x DIMENSIONS unit vectors, from all documents."""
    ship(docs.sparkSession)
    columns = [f"d{d}" for d in range(DIMENSIONS)]
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(context_table, "slot long, " + ", ".join(f"{c} long" for c in columns))
    # SLOTS rows at most
    rows = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = np.zeros((SLOTS, DIMENSIONS))
    if len(rows):
        out[rows.column("slot").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)
    for part in (slice(0, WORD_SLOTS), slice(WORD_SLOTS, SLOTS)):
        own = out[part]
        used = np.abs(own).sum(axis=1) > 0
        own[used] /= np.linalg.norm(own[used], axis=1, keepdims=True) + 1e-12
        if used.any():
            own[used] -= own[used].mean(axis=0)
        own[used] /= np.linalg.norm(own[used], axis=1, keepdims=True) + 1e-12
    return out.astype(np.float32)


def pooled(c: Chunk, vectors: np.ndarray) -> np.ndarray:
    """One row of 3 * DIMENSIONS + 1 features per text of the chunk."""
    words, shapes = token_slots(c)
    n_docs = c.hi - c.lo
    tokens = np.diff(c.first)
    doc = np.repeat(np.arange(n_docs), tokens)
    out = np.zeros((n_docs, 3 * DIMENSIONS + 1), dtype=np.float32)
    some = tokens > 0
    if len(words):
        pairs, n = np.unique(doc * SLOTS + words, return_counts=True)
        v = vectors[pairs % SLOTS]
        begin = np.searchsorted(pairs, np.flatnonzero(some) * SLOTS)
        distinct = np.diff(np.append(begin, len(pairs)))[:, None]
        out[some, :DIMENSIONS] = np.add.reduceat(v * n[:, None].astype(np.float32), begin, axis=0) / tokens[some, None]
        out[some, DIMENSIONS : 2 * DIMENSIONS] = np.add.reduceat(v, begin, axis=0) / distinct
        counts = np.bincount(doc * SHAPE_SLOTS + shapes - WORD_SLOTS, minlength=n_docs * SHAPE_SLOTS).reshape(n_docs, SHAPE_SLOTS).astype(np.float32)
        out[some, 2 * DIMENSIONS : 3 * DIMENSIONS] = (counts @ vectors[WORD_SLOTS:])[some] / tokens[some, None]
        out[some, -1] = np.log1p(tokens[some])
    return out


@dataclass
class Network:
    """Two layers over standardised features; probabilities are sigmoid(logit / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, seed: int = 3) -> Network:
    """Fits by Adam on nine tenths of the rows and calibrates the temperature on the others."""
    width = x.shape[1]
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        flat.b2 = float(np.log(share / (1 - share)))
        return flat
    x = x.astype(np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = max(1, len(x) // 10)
    test, train = order[:held], order[held:]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    params = {"w1": net.w1, "b1": net.b1, "w2": net.w2, "b2": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    step, rate, decay = 0, 0.004, 1e-3
    z = (x - mean) / scale
    best, kept = np.inf, {k: v.copy() for k, v in params.items()}
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            a = np.tanh(z[at] @ params["w1"] + params["b1"])
            p = 1 / (1 + np.exp(-np.clip(a @ params["w2"] + params["b2"], -30, 30)))
            d = (p - y[at]) / len(at)
            da = d[:, None] * params["w2"] * (1 - a * a)
            grads = {"w1": z[at].T @ da + decay * params["w1"], "b1": da.sum(axis=0), "w2": a.T @ d + decay * params["w2"], "b2": np.array([d.sum()])}
            step += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = params["w1"], params["b1"], params["w2"], float(params["b2"][0])
        loss = log_loss(net.logits(x[test]), y[test], 1.0)
        if loss < best:
            best, kept = loss, {k: v.copy() for k, v in params.items()}
    net.w1, net.b1, net.w2, net.b2 = kept["w1"], kept["b1"], kept["w2"], float(kept["b2"][0])
    logits = net.logits(x[test])
    net.temperature = float(min(np.geomspace(0.25, 8, 121), key=lambda t: log_loss(logits, y[test], t)))
    return net


def log_loss(logits: np.ndarray, y: np.ndarray, temperature: float) -> float:
    z = np.clip(logits / temperature, -30, 30)
    return float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y))


def feature_batches(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text"), _CHUNK, TOKENS):
            x = pooled(c, vectors)
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(c.lo, c.hi - c.lo), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "features"])


def score_batches(batches: Iterator[pa.RecordBatch], vectors: np.ndarray, net: Network, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text"), _CHUNK, TOKENS):
            scores = net.scores(pooled(c, vectors))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(c.lo, c.hi - c.lo), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """labels: doc_id, quality. Uses the `sample` labelled documents with the smallest hashes of their ids."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_labelled"), F.col("quality").cast("int").alias("quality")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_labelled"), "_labelled", "quality").limit(sample)
    # at most `sample` rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
    found = rows.select("text", "quality").mapInArrow(lambda it: feature_batches(it, vectors), "quality int, features binary").toArrow()
    if not len(found):
        return fit_network(np.zeros((0, 3 * DIMENSIONS + 1)), np.zeros(0))
    raw = found.column("features").to_pylist()
    y = found.column("quality").to_numpy().astype(np.float64)
    order = sorted(range(len(raw)), key=lambda i: (raw[i], y[i]))  # the rows' order must not matter
    return fit_network(np.stack([np.frombuffer(raw[i], dtype=np.float32) for i in order]), y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score, predicted. labels: doc_id, quality of the documents to learn from."""
    vectors = word_vectors(docs)
    net = train(docs, labels, vectors, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda it: score_batches(it, vectors, net, threshold), f"doc_id {kind}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def drop_poor(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    vectors = word_vectors(docs)
    net = train(docs, labels, vectors, sample)
    names = docs.columns
    at = names.index("text")
    # a text column is sent once, one of another type beside its text
    extra = 0 if docs.schema[at].dataType == T.StringType() else 1

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [net.scores(pooled(c, vectors)) >= threshold for c in chunks(batch.column(0 if extra else at), _CHUNK, TOKENS)]
            kept = batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, dtype=bool)))
            yield pa.RecordBatch.from_arrays(kept.columns[extra:], names)

    # columns go by place, as names may have dots
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{at}").cast("string").alias("text")] * extra, "*").mapInArrow(keep, docs.schema)
