"""URL filters: host and path rules, and for the rest the ratio of two character language models.

Smoothed variable-order Markov models of accepted and of rejected URLs are grouped counts of
character runs. A URL's score is the difference of its log likelihoods divided by its length; the
cut between accepting and rejecting is calibrated on the URLs that rules decide, each scored by models
of the other fold's URLs. All in DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Characters of context at most, and the weight of a shorter context's estimate in counts.
ORDER, WEIGHT = 3, 2.0
_START, _STOP = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path; both empty where url is null or has no ://."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _first_rule(rules, value) -> Column:
    """What ``value`` gives for the longest rule that fits, or null."""
    out = []
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        _, host, path = rule
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out.append(F.when(fits, F.lit(value(rule))))
    return F.coalesce(*out, F.lit(None).cast("string"))


def gram_ratios(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of characters of each text, and each run's log likelihood ratios.

    ``texts`` has id, text, accepted and rejected (how many URLs of that text rules decided so) and fold
    (0 or 1). The first result is (id, gram), a row for every character with its context; the second
    (gram, ratio, ratio_0, ratio_1): by models of all texts, and of all but fold 0's or fold 1's.
    """
    padded = F.concat(F.lit(_START * ORDER), "text", F.lit(_STOP))
    # A text is cut into characters once, and a run is joined from the array: that is linear in the text.
    run = lambda c, i: F.concat(*[F.get(c, i + k) for k in range(ORDER + 1)])
    cut = F.flatten(F.transform(F.array(F.split(padded, "")), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - (ORDER + 1)), lambda i: run(c, i))))
    runs = texts.select("id", "accepted", "rejected", "fold", F.explode(cut).alias("gram"))
    sums = {f"{side}{fold}": F.sum(F.when(F.col("fold") == fold, F.col(of)).otherwise(0)) for side, of in (("a", "accepted"), ("r", "rejected")) for fold in (0, 1)}
    counts = staged(runs.groupBy("gram").agg(*[x.alias(c) for c, x in sums.items()]), "grams")
    # Counts of shorter runs and of contexts are sums over the longest runs; the empty context's are totals.
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first()
    joined = counts
    for k in range(ORDER + 1):
        last, context = F.col("gram").substr(ORDER + 1 - k, k + 1), F.col("gram").substr(ORDER + 1 - k, k)
        for name, key in (("c", last), ("x", context)):
            if (name, k) in (("c", ORDER), ("x", 0)):
                continue
            some = counts.groupBy(key.alias(f"_{name}{k}")).agg(*[F.sum(c).alias(f"{name}{k}{c}") for c in sums])
            joined = joined.withColumn(f"_k{name}{k}", key).join(some, F.col(f"_k{name}{k}") == F.col(f"_{name}{k}"))

    def ratio(folds) -> Column:
        estimates = []
        for side in "ar":
            p = F.lit(1 / 256)
            for k in range(ORDER + 1):
                count = sum((F.col(f"c{k}{side}{f}" if k < ORDER else f"{side}{f}") for f in folds), F.lit(0))
                context = sum((F.col(f"x{k}{side}{f}") if k else F.lit(total[f"{side}{f}"]) for f in folds), F.lit(0))
                p = (count + WEIGHT * p) / (context + WEIGHT)
            estimates.append(F.log(p))
        return estimates[0] - estimates[1]

    ratios = joined.select("gram", ratio((0, 1)).alias("ratio"), ratio((1,)).alias("ratio_0"), ratio((0,)).alias("ratio_1"))
    return runs.select("id", "gram"), staged(ratios, "ratios")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
    Where none fits, the verdict is by the language models: allow where the length-normalised log
    likelihood difference is at least the calibrated cut. ``rule`` is null there. The models' texts
    are host and path with A-Z lower-cased; URLs that rules decide are their examples, all of them
    and as often as they occur. The cut is set on scores that these examples have by models of the
    other fold (texts by their CRC-32, odd or even). Without examples of a side the cut is 0.

    Null urls have an empty host and path, and are judged as the empty text. Repeated rows give
    repeated results; columns other than page_id and url are ignored.
    """
    parts = with_parts(pages.select("page_id", "url")).withColumn("rule", _first_rule(rules, lambda r: r[1] + r[2])).withColumn("by_rule", _first_rule(rules, lambda r: r[0]))
    parts = parts.withColumn("text", F.translate(F.concat("host", "path"), _UPPER, _LOWER))
    side = lambda x: F.sum(F.when(F.col("by_rule") == x, 1).otherwise(0))
    texts = parts.groupBy("text").agg(side("allow").alias("accepted"), side("block").alias("rejected"))
    texts = staged(texts.withColumn("fold", (F.crc32("text") % 2).cast("int")).withColumn("id", F.monotonically_increasing_id()), "texts")
    runs, ratios = gram_ratios(texts)
    means = [(F.sum(c) / F.count("*")).alias(c) for c in ("ratio", "ratio_0", "ratio_1")]
    scores = runs.join(ratios, "gram").groupBy("id").agg(*means)
    known = texts.join(scores, "id").select("text", "accepted", "rejected", F.col("ratio").alias("score"), F.when(F.col("fold") == 0, F.col("ratio_0")).otherwise(F.col("ratio_1")).alias("held"))
    known = staged(known, "scores")
    sums = [F.sum(F.col(c) * f) for c in ("accepted", "rejected") for f in (F.lit(1.0), F.col("held"), F.col("held") * F.col("held"))]
    cut = _cut(*(x or 0.0 for x in known.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()))
    scored = parts.join(known.select(F.col("text").alias("_text"), "score"), F.col("text") == F.col("_text"))
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _cut(n_a: float, sum_a: float, square_a: float, n_r: float, sum_r: float, square_r: float) -> float:
    """Between the two sides' mean scores, as many deviations from one as from the other."""
    if not n_a or not n_r:
        return 0.0
    mean_a, mean_r = sum_a / n_a, sum_r / n_r
    dev_a, dev_r = (math.sqrt(max(s / n - m * m, 1e-12)) for s, n, m in ((square_a, n_a, mean_a), (square_r, n_r, mean_r)))
    return (mean_a * dev_r + mean_r * dev_a) / (dev_a + dev_r)
