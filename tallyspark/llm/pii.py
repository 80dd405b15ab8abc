"""Personal data: patterns, and terms that reveal protected entities.

Base spans are emails, IP addresses, payment cards and phone numbers by pattern (leftmost,
not overlapping within a kind; a match that fails its check is dropped). The protected
entities are each value, the group it belongs to (mail domain, first half of an address,
issuer of a card, start of a phone number), its kind, and the kind "secret": a place where
a word of CUES assigns something.

Information-theoretic sanitisation: a term (a run of letters and digits, at least MIN_TERM
bytes, case folded for ASCII) reveals an entity by log2 P(entity | term) / P(entity) bits.
P(entity | term) is the share of the documents with the term in which it stands within NEAR
tokens of that entity, P(entity) the share of all documents that hold it; all documents are
counted. Terms of at least SHAPED bytes with both letters and digits (keys, digests) seldom
repeat, so they are also counted by their shape, the length: what the corpus tells of the
shape is taken for the term.

A term or shape is disclosing if it was seen near one entity in at least SUPPORT different
contexts (the tokens within NEAR), at least SHARE of its documents have it there, and it
reveals at least BITS bits. Its occurrences, wherever they are, become spans of kind
"term"; `sanitised` text drops terms that point to one entity with REMOVE_SHARE and more,
and generalises others, and names the kind in place of base spans.

Scale: terms near entities are counted from documents with entities only. The documents
of the candidates are counted in the tasks that read them against the candidates' hashes,
which are sent along if there are at most SENT of them; beyond that, tasks give their own
distinct terms with counts, and those are joined. Marking has the same two ways: a
sent list, or a join of the documents' own distinct terms with the disclosing ones.

Null and empty texts have no spans. Repeated rows are documents of their own in shares and
one context in the support. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DIGITS, LETTERS, TOKENS, Chunk, Scratch, as_long, chunks, lists, mix, ship

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 12
MIN_TERM = 4
SHAPED = 16
SUPPORT = 3
SHARE = 0.5
BITS = 4.0
REMOVE_SHARE = 0.9
SENT = 500_000

# Fixed patterns. The local part of an email and a number's parts are cut out by hand, so that
# the time is linear in the text's length whatever it holds.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_PART = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Words that name a secret. Fixed values.
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")
CUE_BYTES = 24
_CUE = re.compile(rb"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(CUES).encode() + rb")[\"']?[ \t]{0,3}\Z")
SECRET = 4
#: Kinds of bytes: letters and digits stand in one token.
TERMS = np.where(TOKENS == DIGITS, LETTERS, TOKENS).astype(np.uint8)
_SHAPE = np.uint64(0x5348415045)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at:
            yield begin, m.end()
            last = m.end()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            # a number of many digits is above 255 unless all but its last three are zeros
            if all(len(p := x.group().lstrip("0")) <= 3 and int(p or "0") <= 255 for x in four):
                yield four[0].start(), four[3].end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans in order."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def text_at(c: Chunk, i: int) -> str:
    return c.data[c.ends[i] : c.ends[i + 1]].tobytes().decode("utf-8", "replace")


def may_have_spans(c: Chunk) -> np.ndarray:
    """Texts with an @ or a digit; others have no base spans."""
    marks = (c.data == 0x40) | ((c.data >= 0x30) & (c.data <= 0x39))
    sums = np.concatenate([[0], np.cumsum(marks)])
    return np.flatnonzero(sums[c.ends[1:]] > sums[c.ends[:-1]])


def cues(c: Chunk) -> dict[int, list[tuple[int, int]]]:
    """Byte ranges, by text, from a word of CUES to the = or : that follows it."""
    out: dict[int, list[tuple[int, int]]] = {}
    signs = np.flatnonzero((c.data == 0x3D) | (c.data == 0x3A))
    owners = np.searchsorted(c.ends, signs, side="right") - 1
    for p, i in zip(signs.tolist(), owners.tolist(), strict=True):
        low = max(int(c.ends[i]), p - CUE_BYTES)
        if m := _CUE.search(c.data[low:p].tobytes()):
            out.setdefault(i, []).append((low + m.start(), p + 1))
    return out


def byte_places(c: Chunk, i: int) -> np.ndarray:
    """Byte offset (in the chunk) of each code point of text i, and of its end."""
    own = c.data[c.ends[i] : c.ends[i + 1]]
    return np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own)) + c.ends[i]


def terms(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, which of them are terms, and hashes of their shapes (0: none)."""
    h = c.hashes(5, lower=True)
    length = c.stop - c.start
    usable = (TERMS[c.data[c.start]] == LETTERS) & (length >= MIN_TERM)
    digits = np.concatenate([[0], np.cumsum(TOKENS[c.data] == DIGITS)])
    digits = digits[c.stop] - digits[c.start]
    shaped = usable & (length >= SHAPED) & (digits > 0) & (digits < length)
    return h, usable, np.where(shaped, mix(length.astype(np.uint64) ^ _SHAPE), np.uint64(0))


def entities_of(kind: int, value: str) -> list[int]:
    """Hashes of the entities that a base span names: the value, its group and its kind."""
    plain = value.lower() if kind == 0 else _NOT_DIGIT.sub("." if kind == 1 else "", value)
    group = plain.partition("@")[2] if kind == 0 else ".".join(plain.split(".")[:2]) if kind == 1 else plain[:6]
    names = (f"{kind}:{plain}", f"{kind}/{group}", f"{kind}")
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in names]


def near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entity, term, context of the terms and shapes near the entities of each document (once each), and each of its entities with a null term."""
    for batch in batches:
        for c in chunks(batch.column("text"), kinds=TERMS):
            entities, found, contexts = [], [], []
            told = cues(c)
            h = usable = shapes = None
            for i in sorted({*may_have_spans(c).tolist(), *told}):
                text = text_at(c, i)
                spans = base_spans(text)
                if not spans and i not in told:
                    continue
                if h is None:
                    h, usable, shapes = terms(c)
                place = byte_places(c, i)
                named = [(int(place[a]), int(place[b]), entities_of(kind, text[a:b])) for a, kind, b in spans]
                named += [(a, b, [SECRET]) for a, b in told.get(i, ())]
                first, last = c.first[i], c.first[i + 1]
                free = usable[first:last].copy()
                for a, b, _ in named:
                    free[(c.start[first:last] < b) & (c.stop[first:last] > a)] = False
                pairs: dict[tuple[int, int], int] = {}
                values: set[int] = set()
                for a, b, own in named:
                    x, y = np.searchsorted(c.start, [a, b])
                    near = np.arange(max(first, x - NEAR), min(last, y + NEAR))
                    near = near[free[near - first]]
                    context = int(mix(np.array([len(near)], dtype=np.uint64) + h[near].sum(dtype=np.uint64)).view(np.int64)[0])
                    values.update(own)
                    for t in {*as_long(h[near]).tolist(), *as_long(shapes[near][shapes[near] > 0]).tolist()}:
                        for e in own:
                            pairs[e, t] = min(context, pairs.get((e, t), context))
                entities += [e for e, _ in pairs] + list(values)
                found += [t for _, t in pairs] + [None] * len(values)
                contexts += list(pairs.values()) + [0] * len(values)
            yield pa.RecordBatch.from_arrays([pa.array(entities, pa.int64()), pa.array(found, pa.int64()), pa.array(contexts, pa.int64())], ["entity", "term", "context"])


def occurrences(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers and hashes of all terms, and then of those with a shape."""
    h, usable, shapes = terms(c)
    own, shaped = np.flatnonzero(usable), np.flatnonzero(shapes)
    return np.concatenate([own, shaped]), np.concatenate([h[own], shapes[shaped]])


def distinct_terms(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, term or shape hash) pairs of a chunk, each once."""
    at, h = occurrences(c)
    doc = np.searchsorted(c.first, at, side="right") - 1
    _, at = np.unique(mix(h ^ mix(doc.astype(np.uint64))), return_index=True)
    return doc[at], h[at]


def count_batches(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """term, documents: of the wanted terms (sorted hashes), or of all terms a chunk at a time."""
    total = np.zeros(0 if wanted is None else len(wanted), dtype=np.int64)
    for batch in batches:
        for c in chunks(batch.column("text"), kinds=TERMS):
            if wanted is not None:
                # most terms aren't wanted: look them up before making them distinct
                token, h = occurrences(c)
                at = np.searchsorted(wanted, h)
                at[at == len(wanted)] = 0
                hit = wanted[at] == h
                doc = np.searchsorted(c.first, token[hit], side="right") - 1
                pairs = np.unique(doc * len(wanted) + at[hit])
                total += np.bincount(pairs % len(wanted), minlength=len(wanted))
            else:
                _, h = distinct_terms(c)
                found, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(found)), pa.array(n.astype(np.int64))], ["term", "documents"])
    if wanted is not None:
        yield pa.RecordBatch.from_arrays([pa.array(as_long(wanted)), pa.array(total)], ["term", "documents"])


def sent_hashes(df: DataFrame, column: str, sent: int) -> np.ndarray | None:
    """The sorted hashes of a column if there are at most `sent`, else None."""
    rows = df.select(column).distinct().limit(sent + 1).toArrow()
    if len(rows) > sent:
        return None
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def disclosing_terms(docs: DataFrame, scratch: Scratch, support: int = SUPPORT, share: float = SHARE, bits: float = BITS, sent: int = SENT) -> DataFrame:
    """term (hash), share, bits of the terms that disclose an entity: their most certain one."""
    base = docs.select(F.col("text").cast("string").alias("text"))
    near = scratch.keep(base.mapInArrow(near_batches, "entity long, term long, context long"), "near")
    pairs = near.where("term is not null").groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("contexts"))
    pairs = scratch.keep(pairs.where(F.col("contexts") >= support), "pairs")
    wanted = sent_hashes(pairs, "term", sent)
    if wanted is not None and not len(wanted):
        return pairs.select("term", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits"))
    counts = base.mapInArrow(lambda it: count_batches(it, wanted), "term long, documents long")
    if wanted is None:
        counts = counts.join(pairs.select("term").distinct(), "term", "left_semi")
    counts = counts.groupBy("term").agg(F.sum("documents").alias("documents"))
    entities = near.where("term is null").groupBy("entity").agg(F.count(F.lit(1)).alias("entity_documents"))
    total = docs.count()
    told = pairs.join(counts, "term").join(entities, "entity")
    certain = F.col("together") / F.col("documents")
    told = told.select("term", certain.alias("share"), F.log2(certain * F.lit(float(total)) / F.col("entity_documents")).alias("bits"))
    told = told.where((F.col("share") >= share) & (F.col("bits") >= bits))
    found = scratch.keep(told.groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits")), "disclosing")
    scratch.drop("near", "pairs")
    return found


def spans_of(c: Chunk, i: int, text: str | None, hit: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans of text i: its base spans, and terms at the token numbers `hit` that no base span touches."""
    spans = base_spans(text) if text is not None else []
    if len(hit):
        place = byte_places(c, i)
        a, b = np.searchsorted(place, c.start[hit]), np.searchsorted(place, c.stop[hit])
        # base spans before a term's end, and how far they reach; terms never touch each other
        spans.sort()
        starts, reach = np.array([x for x, _, _ in spans], dtype=np.int64), np.maximum.accumulate(np.array([y for _, _, y in spans] or [0], dtype=np.int64))
        before = np.searchsorted(starts, b)
        free = (before == 0) | (reach[np.maximum(before - 1, 0)] <= a)
        spans += [(s, 4, e) for s, e in zip(a[free].tolist(), b[free].tolist(), strict=True)]
    return sorted(spans)


def write_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def sanitise(text: str, spans: list[tuple[int, int, int]], removed: set[int]) -> str:
    """The text with its spans generalised to their kind; spans that begin at one of `removed` are dropped. Of overlapping spans the first counts."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], "" if k == 4 and s in removed else f"<{KINDS[k].upper()}>"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def hits_of(keys: np.ndarray, known: np.ndarray, shares: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers, ascending, whose key is known, with the largest share of each. keys: of the tokens `token`."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    hit = np.flatnonzero(known[at] == keys)
    token, share = token[hit], shares[at[hit]]
    order = np.lexsort((-share, token))
    token, share = token[order], share[order]
    first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, dtype=bool)
    return token[first], share[first]


def mark_batches(batches: Iterator[pa.RecordBatch], sent: tuple[np.ndarray, np.ndarray] | None, texts: bool) -> Iterator[pa.RecordBatch]:
    """Spans of each document. Disclosing terms and their shares are `sent`, or come with each row."""
    for batch in batches:
        for c in chunks(batch.column("text"), kinds=TERMS):
            docs = c.hi - c.lo
            known, shares = sent if sent is not None else (np.zeros(0, dtype=np.uint64), np.zeros(0))
            hits, sure = np.zeros(0, dtype=np.int64), np.zeros(0)
            if sent is None:
                own = batch.column("terms").slice(c.lo, docs)
                values = own.flatten()
                owner = np.repeat(np.arange(docs), np.asarray(own.value_lengths().fill_null(0)))
                keys = mix(values.field("term").to_numpy(zero_copy_only=False).view(np.uint64) ^ mix(owner.astype(np.uint64)))
                order = np.argsort(keys)
                known, shares = keys[order], values.field("share").to_numpy(zero_copy_only=False)[order]
            if len(known):
                token, h = occurrences(c)
                if sent is None:
                    h = mix(h ^ mix((np.searchsorted(c.first, token, side="right") - 1).astype(np.uint64)))
                hits, sure = hits_of(h, known, shares, token)
            bounds = np.searchsorted(hits, c.first)
            based = set(may_have_spans(c).tolist())
            counts = np.zeros((docs, 6), dtype=np.int64)
            shas, written, clean = [], [], []
            empty = hashlib.sha256(b"").hexdigest()
            for i in range(docs):
                own_hits = hits[bounds[i] : bounds[i + 1]]
                if i not in based and not len(own_hits):
                    shas.append(empty)
                    written.append("")
                    if texts:
                        clean.append(text_at(c, i))
                    continue
                text = text_at(c, i)
                spans = spans_of(c, i, text if i in based else None, own_hits)
                for _, k, _ in spans:
                    counts[i, k] += 1
                shas.append(hashlib.sha256(write_spans([x for x in spans if x[1] < 4]).encode()).hexdigest())
                written.append(write_spans(spans))
                if texts:
                    place = byte_places(c, i)
                    removed = set(np.searchsorted(place, c.start[own_hits[sure[bounds[i] : bounds[i + 1]] >= REMOVE_SHARE]]).tolist())
                    clean.append(sanitise(text, spans, removed))
            counts[:, 5] = counts[:, :5].sum(axis=1)
            numbers = [pa.array(counts[:, k]) for k in range(6)]
            columns = [batch.column("doc_id").slice(c.lo, docs), *numbers[:4], pa.array(shas, pa.string()), pa.array(written, pa.string()), *numbers[4:]]
            names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_term", "n_spans"]
            if texts:
                columns.append(pa.array(clean, pa.string()))
                names.append("sanitised")
            yield pa.RecordBatch.from_arrays(columns, names)


def term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its number and the distinct terms of its text."""
    for batch in batches:
        for c in chunks(batch.column("text"), kinds=TERMS):
            doc, h = distinct_terms(c)
            order = np.argsort(doc, kind="stable")
            docs = c.hi - c.lo
            own = [batch.column(x).slice(c.lo, docs) for x in ("row", "doc_id", "text")]
            yield pa.RecordBatch.from_arrays([*own, lists(as_long(h[order]), np.bincount(doc, minlength=docs), pa.int64())], ["row", "doc_id", "text", "all_terms"])


def private_spans(docs: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS, sent: int = SENT, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans; with `texts` also sanitised."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pii")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, n_spans long" + (", sanitised string" if texts else "")
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    told = disclosing_terms(docs, scratch, support, share, bits, sent)
    wanted = sent_hashes(told, "term", sent)
    if wanted is not None:
        rows = told.toArrow()  # at most `sent` rows
        order = np.argsort(rows.column("term").to_numpy().view(np.uint64))
        known = rows.column("term").to_numpy().view(np.uint64)[order], rows.column("share").to_numpy().astype(np.float64)[order]
        return base.mapInArrow(lambda it: mark_batches(it, known, texts), out)
    rows = scratch.keep(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    found = rows.mapInArrow(term_lists, f"row long, doc_id {kind}, text string, all_terms array<long>").select("row", F.explode("all_terms").alias("term"))
    own = found.join(told.select("term", "share"), "term").groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    joined = rows.join(own, "row", "left").select("doc_id", "text", F.coalesce("terms", F.array().cast("array<struct<term:long,share:double>>")).alias("terms"))
    return joined.mapInArrow(lambda it: mark_batches(it, None, texts), out)
