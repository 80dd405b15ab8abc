import hashlib
import re
from collections import defaultdict
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import fingerprints, pii, quality, urls, warc
from tallyspark.llm.queries import queries

from .helpers import DOC_SCHEMA, by_id, documents, frame, prose, words

SF = "/root/testdata/sf0.01"


# fingerprints


def edits(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t = t or ""
        n = len(t) // 4
        out[i] = t[: len(t) - n] + (rows[(k + 1) % len(rows)][1] or "")[:n]
    return out


def check_fingerprints(rows, got):
    after = {a: b for (a, _), (b, _) in zip(sorted(rows), sorted(rows)[1:] + sorted(rows)[:1], strict=True)}
    edited, text_of = edits(rows), dict(rows)
    bits = lambda x: int(x, 16)
    alike = lambda a, b: 1 - (bits(a) ^ bits(b)).bit_count() / 128
    same = defaultdict(set)
    for i, r in got.items():
        assert r.n_chars == len(text_of[i] or "")
        assert r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert r.near_edited == alike(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == alike(r.fingerprint, got[after[i]].fingerprint)
        same[text_of[i] or ""].add(r.fingerprint)
        same[edited[i]].add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in same.values()) and len(got) == len(rows)


@pytest.mark.parametrize("per_range", [3, 500])
def test_fingerprints_of_awkward_texts(spark, per_range):
    texts = [prose(i % 9, 3 + i * 7) for i in range(40)] + [None, "", "é", "日本語 のテキスト 🙂 x", "a b", "a", " \n ", "b a"]
    docs = frame(spark, texts, first=-7)
    check_fingerprints([(i - 7, t) for i, t in enumerate(texts)], by_id(fingerprints.edited_fingerprints(docs, per_range)))
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(docs.limit(1)).collect()[0]
    assert one.near_next == 1.0


def test_fingerprint_is_the_majority_of_the_terms_bits(spark):
    text = prose(3, 200)
    r = fingerprints.fingerprint_votes(spark.createDataFrame([(1, text)], "k long, t string"), ["k"], "t").collect()[0]
    w = words(text)
    rows = spark.createDataFrame(list(zip(w, w[1:], strict=False)), "a string, b string").select(F.xxhash64("a", "b").alias("x")).select("x", F.xxhash64("x", F.lit(1)).alias("y")).collect()
    want = ""
    for c in "xy":
        votes = [sum(((h[c] >> i) & 1) * 2 - 1 for h in rows) for i in range(64)]
        want += f"{sum(1 << i for i in range(64) if votes[i] > 0):016x}"
    assert r.fingerprint == want


def test_fingerprint_query_tells_edits_from_neighbours(spark):
    got = by_id(queries()["op5_fingerprints"](spark, SF))
    check_fingerprints([(d.doc_id, d.text) for d in documents(spark).collect()], got)
    long = [r for r in got.values() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_near_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(30)]
    prints = list(base)
    for b in base:
        for k in range(1, 6):
            x = b
            for bit in rng.choice(128, k, replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    names = [f"{x:032x}" for x in prints] + [f"{base[0]:032x}", None]
    want = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in set(names[:-1]) for b in set(names[:-1]) if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    got = fingerprints.near_fingerprints(spark.createDataFrame([(x,) for x in names], "fingerprint string"), 3).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


# urls


def url_parts(url):
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url or "")
    host = m.group(1) if m else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), m.group(2) if m else ""


def url_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def url_model(texts, order=4):
    """Witten-Bell log ratios by plain counting; texts: (text, accepted, rejected)."""
    counts = [defaultdict(lambda: defaultdict(int)) for _ in "ar"]
    for t, *n in texts:
        padded = urls.PAD * order + t + urls.END
        for i in range(order, len(padded)):
            for c in (0, 1):
                for k in range(order + 1):
                    if n[c]:
                        counts[c][padded[i - k : i]][padded[i]] += n[c]

    def ratio(gram):
        logs = []
        for c in (0, 1):
            p = 1 / 65536
            for k in range(order + 1):
                seen = counts[c].get(gram[order - k : order], {})
                n, kinds = sum(seen.values()), len(seen)
                if n:
                    p = (seen.get(gram[order], 0) + kinds * p) / (n + kinds)
            logs.append(np.log(p))
        return round((logs[0] - logs[1]) * urls.SCALE)

    def score(t):
        padded = urls.PAD * order + t + urls.END
        return sum(ratio(padded[i - order : i + 1]) for i in range(order, len(padded))) / (len(t) + 1) / urls.SCALE

    return score


def check_urls(spark, pages, head):
    rows = pages.collect()
    got = defaultdict(list)
    for r in urls.judge_urls(pages, head=head).collect():
        got[r.page_id].append(r)
    body = lambda u: re.sub(r"(?s)\A.*?://", "", u or "", count=1)
    sums = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        fit = url_rule(*url_parts(r.url))
        sums[body(r.url)][2 if fit is None else int(fit[1] == "block")] += 1
    keys = {x.t: x.h for x in spark.createDataFrame([(t,) for t in sums], "t string").select("t", (F.pmod(F.xxhash64("t"), F.lit(5)) == 0).alias("h")).collect()}
    score = url_model([(t, a, r) for t, (a, r, _) in sums.items() if not keys[t]])
    stats = [[0, 0.0, 0.0], [0, 0.0, 0.0]]
    for t, n in sums.items():
        if keys[t] and (n[0] or n[1]):
            s = score(t)
            for c in (0, 1):
                stats[c] = [stats[c][0] + n[c], stats[c][1] + n[c] * s, stats[c][2] + n[c] * s * s]
    threshold = urls.calibrated(*stats)
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        x = got[r.page_id][0]
        host, path = url_parts(r.url)
        fit = url_rule(host, path)
        assert (x.host, x.path, x.rule) == (host, path, fit and fit[0])
        assert x.threshold == pytest.approx(threshold, abs=1e-6)
        if fit:
            assert x.verdict == fit[1]
        else:
            assert x.score == pytest.approx(score(body(r.url)), abs=1e-9)
            assert x.verdict == ("allow" if x.score >= x.threshold else "block")


def test_url_query_against_plain_counting(spark):
    check_urls(spark, spark.read.parquet(f"{SF}/pages.parquet"), urls.HEAD)


def test_awkward_urls(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/ES/x", "http://example.org/es/?q#f", "x://sub.example.org/en/12", "http://example.com/fr/é日本", "http://com/de/", "http://notorg/", "http://a.org?x/", "http://a.org/#/", "a://b.com/fr/\nline", "u://x.com/fr/a://b.com/de/"]
    many = [f"https://s{i % 7}.example.{'com' if i % 3 else 'org'}/{['fr', 'de', 'es', 'en'][i % 4]}/{i}" for i in range(80)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(odd + many + ["https://same.net/x"] * 30)], "page_id long, url string, html string")
    check_urls(spark, pages, 40)
    assert urls.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages.where("page_id < 4")).collect()} == {"allow"}


# WARC


def test_warc_round_trip(spark, tmp_path):
    same, tricky = "s" * 1200, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "WARC/1.1\r\n" * 50
    html = [None, "", "a", same, same, "é" * 600, "é" * 600, tricky, tricky + "!", "WARC/1.1\r\n", "\r\n", "t" * 999, "t" * 999, "big " * 500_000, same]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h{i}.org/ü x\r\n{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "a")
    warc.write_archives(pages, path, records_per_file=7)
    whole = warc.transactions(warc.read_archives(spark, path)).collect()
    assert len(whole) == len(html)
    for x in whole:
        i = int(re.search(r"page-id: (\d+)", x.metadata.payload.decode()).group(1))
        assert x.request.concurrent_to == x.metadata.concurrent_to == x.response.record_id
        assert x.response.target_uri == (None if i == 2 else quote(f"http://h{i}.org/ü x\r\n{i}", safe=":/").replace("%20", "+"))
        assert x.response.payload.decode() == ((html[i] or "") if x.response.kind == "response" else "")
    got = by_id(warc.archive_round_trip(pages), "page_id")
    for i, h in enumerate(html):
        body = (h or "").encode()
        later = max((j for j, o in enumerate(html) if (o or "") == (h or "")), default=i)
        revisit = len(body) >= 1000 and later != i
        assert tuple(got[i]) == (i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", later if revisit else None)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


# personal data


PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def spans_brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def check_pii(docs, got):
    for d in docs:
        base = spans_brute(d.text)
        r = got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        wrote = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r.base_sha256 == hashlib.sha256(wrote.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term:")) == wrote


def test_pii_query_against_patterns(spark):
    check_pii(documents(spark).collect(), by_id(queries()["op6_pii"](spark, SF)))


def test_pii_awkward_texts(spark):
    import random

    r = random.Random(1)
    odd = ["a@b.c@d.e", "@x.y@z.w", "é@b.co x.y+z@a-b.c-d.e.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.0255 000001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 1", "+1 (555) 010-9999", "+12345678901234567", "+1.2.3.4+5", None, "", "日本 a@b.co", "1" * 5000, "a" * 5000 + "@", "++1 23 45 67 89)"]
    odd += ["".join(r.choice("01 29.-+@aé(") for _ in range(80)) for _ in range(150)]
    docs = frame(spark, odd)
    check_pii(docs.collect(), by_id(pii.private_spans(docs)))
    assert pii.private_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [500_000, 1])
def test_terms_near_an_entity_of_many_documents_reveal_little(spark, sent):
    # a third of all documents hold the address, so no term can tell more than log2(3) bits of it
    texts = [f"{prose(i, 20)} {'Zorblatt' if i < 4 else ''} hot@corp.example {prose(i + 500, 20)}" for i in range(100)]
    texts += [f"{prose(i + 1000, 30)}" for i in range(200)]
    got = pii.private_spans(frame(spark, texts), sent=sent).collect()
    assert len(got) == 300 and sum(r.n_email for r in got) == 100
    assert not [r.spans for r in got if "term:" in r.spans]
    told = pii.private_spans(frame(spark, texts), sent=sent, bits=1.5).collect()
    assert sorted(r.doc_id for r in told if "term:" in r.spans) == [1, 2, 3, 4]


@pytest.mark.parametrize("sent", [500_000, 1])
def test_terms_that_reveal_an_entity(spark, sent):
    texts = [f"{prose(i, 20)} Zorblatt writes to secret@corp.example and {prose(i + 90, 20)}" for i in range(6)]
    texts += [f"zorblatt alone {prose(i + 300, 30)}" for i in range(2)]
    texts += [f"wherever {prose(i + 500, 30)} common letters" for i in range(200)]
    texts += [f"wherever mail{i}@x.example common letters {prose(i + 800, 9)}" for i in range(5)]
    docs = frame(spark, texts)
    got = by_id(pii.private_spans(docs, sent=sent, texts=True))
    for i, t in enumerate(texts, 1):
        at = t.lower().find("zorblatt")
        found = {t[int(a) : int(b)].lower() for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x) if k == "term"}
        assert found == ({"zorblatt", "writes"} if at >= 0 and "writes" in t else {"zorblatt"} if at >= 0 else set())
        assert "zorblatt" not in got[i].sanitised.lower() and "@" not in got[i].sanitised
    assert "<TERM>" in got[7].sanitised and got[20].sanitised == texts[19]


# quality


def area(scores, y):
    order = np.argsort(scores)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    good = y == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_quality_on_held_out_labels(spark):
    got = by_id(queries()["op1_quality"](spark, SF))
    labels = by_id(spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(got) == 1000
    import zlib

    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[i].score, x.quality) for i, x in labels.items() if got[i].held_out]
    assert area(np.array([s for s, _ in held]), np.array([y for _, y in held])) > 0.9
    assert got == by_id(queries()["op1_quality"](spark, SF))


def test_quality_awkward_tables(spark):
    texts = [None, "", "\n", "junk!! JUNK!! " * 9, prose(1, 40), "é" * 100_000] + [prose(i, 30) if i % 2 else f"SPAM{i}!! BUY$$$ " * 20 for i in range(80)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 87)] + [(None, 1), (9, None), (10, 5)], "doc_id long, quality int")
    got = by_id(quality.quality_scores(docs, labels))
    assert len(got) == len(texts)
    kept = {r.doc_id for r in quality.drop_poor(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.score >= 0.3}
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r.score > 0.5 for r in quality.quality_scores(docs, labels.where("quality = 1")).collect())
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.drop_poor(docs.withColumn("score", F.lit(1)), labels).columns == [*docs.columns, "score"]


def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 5))
    y = (rng.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.fit_network(x[:4000], y[:4000])
    p = net.scores(x[4000:])
    for low in (0.1, 0.3, 0.5, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[4000:][part].mean()) < 0.08


def test_schema_of_documents_is_kept(spark):
    assert spark.createDataFrame([], DOC_SCHEMA).columns == documents(spark).columns
