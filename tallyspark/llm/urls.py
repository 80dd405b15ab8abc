"""URL filter: allow and block rules, then a character language-model ratio.

Host and path are cut out of the url; a rule (host, path prefix) fits its host and all
subdomains, and the longest fitting rule decides. Urls that a rule decides are the
accepted and rejected examples of two smoothed variable-order Markov models over the
characters of the url after its scheme. Other urls are judged by the models' length-
normalised log-likelihood difference, against a calibrated threshold.

Models: every position of a padded url is one gram of ORDER context characters and the
character that follows. One aggregation counts the grams of all urls by class; counts of
shorter contexts are sums of those. Probabilities are interpolated from short to long
contexts (Witten-Bell: a context seen n times with t different followers trusts its own
counts with weight n / (n + t)), so unseen contexts back off to shorter ones.

Calibration: a fifth of the examples (by a hash of the url) is kept from the counts; the
scores of the two classes there give the threshold: the point between their means that
lies equally many standard deviations from both.

Scale: only distinct grams carry model values. Grams that make up at least 1 / HEAD of all
positions, so at most HEAD of them, are broadcast; the positions of other grams are
shuffled. Log ratios are held as integers of 1e-6, so sums do not depend on their order.

Defined cases: a null url or one without "://" has empty host and path, no rule, and is
scored like any other text (null: as empty). An empty text is scored by the chance of an
end after the padding. If there
are no examples of one class, or none of it to calibrate on, the threshold is 0. Ties
(difference equal to the threshold) are allowed. Repeated rows are counted and returned as
often as they occur. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.inputs import spread
from .common import Scratch

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 4
HEAD = 32768
#: Before the first character, and after the last one.
PAD, END = "\u0002", "\u0003"
SCALE = 1_000_000
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if there is none."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(text: Column, order: int = ORDER) -> Column:
    """The grams of a text, one for each character and the end."""
    padded = F.concat(F.lit(PAD * order), text, F.lit(END))
    # 1-based positions of the grams' first characters
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def gram_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, ratio: the log-likelihood difference of each counted gram in units of 1 / SCALE.

    counts: gram, a (in accepted urls), r (in rejected ones); rows with zeros are only scored.
    """
    out = counts.select("gram")
    for k in range(order + 1):
        level = counts.select(F.substring("gram", order - k + 1, k + 1).alias("g"), "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = Window.partitionBy(F.substring("g", 1, k))
        level = level.select(
            F.col("g").alias(f"g{k}"),
            *[x for c in "ar" for x in (F.col(c).alias(f"{c}{k}"), F.sum(c).over(context).alias(f"{c}n{k}"), F.sum(F.sign(c)).over(context).cast("long").alias(f"{c}t{k}"))],
        )
        out = out.join(level, F.substring("gram", order - k + 1, k + 1) == F.col(f"g{k}")).drop(f"g{k}")
    chance = {}
    for c in "ar":
        p: Column = F.lit(1.0 / 65536)
        for k in range(order + 1):
            n, t = F.col(f"{c}n{k}"), F.col(f"{c}t{k}")
            p = F.when(n == 0, p).otherwise((F.col(f"{c}{k}") + t * p) / (n + t))
        chance[c] = p
    return out.select("gram", F.round((F.ln(chance["a"]) - F.ln(chance["r"])) * SCALE).cast("long").alias("ratio"))


def judge_urls(pages: DataFrame, rules=RULES, order: int = ORDER, head: int = HEAD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (difference per character; null where a rule decides), threshold."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    url = F.col("url").cast("string")
    base = pages.select("page_id", url.alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
    body = F.coalesce(F.regexp_extract("url", r"(?s)\A(?:.*?://)?(.*)\z", 1), F.lit(""))
    base = base.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("decided"), body.alias("_text"))
    # equal texts get equal scores: they are scored once
    texts = base.groupBy("_text").agg(
        F.sum((F.col("decided") == "allow").cast("long")).alias("a"),
        F.sum((F.col("decided") == "block").cast("long")).alias("r"),
        F.sum(F.col("decided").isNull().cast("long")).alias("u"),
    )
    texts = texts.select(
        "_text",
        F.coalesce("a", F.lit(0)).alias("a"),
        F.coalesce("r", F.lit(0)).alias("r"),
        "u",
        (F.pmod(F.xxhash64("_text"), F.lit(5)) == 0).alias("kept_out"),
        F.xxhash64("_text").alias("_key"),
        F.xxhash64("_text", F.lit(1)).alias("_key2"),
    )
    # a small table is one file; its grams are made on all cores
    texts = spread(scratch.keep(texts, "texts"))
    used = F.when(F.col("kept_out"), F.lit(0))
    positions = texts.select(F.explode(grams(F.col("_text"), order)).alias("gram"), used.otherwise(F.col("a")).alias("a"), used.otherwise(F.col("r")).alias("r"))
    counts = scratch.keep(positions.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("n")), "counts")
    model = scratch.keep(gram_ratios(counts, order).join(counts.select("gram", "n"), "gram"), "model")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = model.where(F.col("n") >= max(1, -(-total // head))).select("gram", "ratio")
    rare = model.where(F.col("n") < max(1, -(-total // head))).select("gram", F.col("ratio").alias("rare_ratio"))

    scored = texts.where((F.col("u") > 0) | (F.col("kept_out") & (F.col("a") + F.col("r") > 0)))
    at = scored.select("_key", "_key2", F.explode(grams(F.col("_text"), order)).alias("gram"))
    # at most `head` rows, as each makes up 1 / head of the positions
    at = at.join(F.broadcast(frequent), "gram", "left")
    near = at.where("ratio is not null").groupBy("_key", "_key2").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"))
    far = at.where("ratio is null").groupBy("gram", "_key", "_key2").agg(F.count(F.lit(1)).alias("times")).join(rare, "gram")
    far = far.groupBy("_key", "_key2").agg(F.sum(F.col("rare_ratio") * F.col("times")).alias("sum"), F.sum("times").alias("n"))
    scores = near.unionByName(far).groupBy("_key", "_key2").agg((F.sum("sum") / F.sum("n") / SCALE).alias("score"))
    scores = scratch.keep(scored.select("_text", "_key", "_key2", "a", "r", "u", "kept_out").join(scores, ["_key", "_key2"]).drop("_key", "_key2"), "scores")

    scratch.drop("texts", "counts", "model")
    held = scores.where("kept_out")
    # scores may lie in millions of urls, but this is one row
    fit = held.agg(
        *[x.alias(f"{c}{k}") for c in "ar" for k, x in enumerate((F.sum(c), F.sum(F.col(c) * F.col("score")), F.sum(F.col(c) * F.col("score") * F.col("score"))))]
    ).first()
    threshold = calibrated([fit["a0"], fit["a1"], fit["a2"]], [fit["r0"], fit["r1"], fit["r2"]])
    open_texts = scores.where("u > 0").select("_text", "score")
    undecided = base.where("decided is null").join(open_texts, "_text", "left")
    decided = base.where("decided is not null").withColumn("score", F.lit(None).cast("double"))
    verdict = F.coalesce("decided", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return decided.unionByName(undecided.select(*decided.columns)).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def calibrated(accepted: list, rejected: list) -> float:
    """Threshold from (count, sum, sum of squares) of both classes' scores."""
    if not accepted[0] or not rejected[0]:
        return 0.0
    (ma, sa), (mr, sr) = ((s / n, max(q / n - (s / n) ** 2, 1e-12) ** 0.5) for n, s, q in (accepted, rejected))
    return float(round((ma * sr + mr * sa) / (sa + sr), 9))
