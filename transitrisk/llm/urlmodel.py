"""URL filter by a character language-model ratio, in DataFrame functions only.

URLs that a rule accepts or rejects are the training classes. For each class a
variable-order Markov model with Witten-Bell smoothing gives the probability
of a character after the ``order`` characters before it, falling back to
shorter contexts where the longer one is rare or unseen. A URL's score is the
mean log ratio of the accepted to the rejected model over its characters; the
cut-off is calibrated on the labelled URLs, each scored by models that have
not seen its own fold.

A position's log ratio depends on its last order + 1 characters only, so the
models are evaluated once per distinct n-gram and joined to the positions.
The ratio is held in whole nanonats: sums do not depend on their order.

Defined results: a null URL is empty, has no characters, score null, and is
accepted; repeated URLs count as often as they stand there; if a class has no
URLs, nothing can be told and every URL without a rule is accepted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitrisk.llm.common import stored

ORDER = 4
FOLDS = 4
START, END = "\x02", "\x03"
ALPHABET = 256.0
NANO = 1e9

# Fixed values of the contract: host, path prefix, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. Rules are a parameter list."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    name = verdict = None
    for fit, (h, p, v) in reversed(list(zip(fits, ordered))):
        name = F.when(fit, F.lit(h + p)).otherwise(F.lit(None).cast("string") if name is None else name)
        verdict = F.when(fit, F.lit(v)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return name, verdict


def _grams(order: int) -> F.Column:
    """The order + 1 characters ending at every position of ``url`` and at its end mark."""
    padded = F.concat(F.lit(START * order), F.col("url"), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length("url") + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def gram_ratios(urls: DataFrame, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """(gram, ratio): for every distinct gram the log ratio in nanonats, one
    entry per left-out fold and the last for no fold left out."""
    classes = [(c, f) for c in ("allow", "block") for f in range(folds)]
    counted = stored(
        urls.select("label", "fold", "copies", F.explode(_grams(order)).alias("gram")).groupBy("gram").agg(
            *[F.sum(F.when((F.col("label") == c) & (F.col("fold") == f), F.col("copies")).otherwise(0)).alias(f"{c}{f}")
              for c, f in classes]), "url-grams")
    # per class: counts without each fold in turn, then with all
    def without(c):
        total = reduce(lambda a, b: a + b, [F.col(f"{c}{f}") for f in range(folds)])
        return F.array(*[total - F.col(f"{c}{f}") for f in range(folds)], total)

    level = counted.select("gram", without("allow").alias("a"), without("block").alias("b"))
    variants = range(folds + 1)

    def summed(col):
        return F.array(*[F.sum(F.col(col)[v]) for v in variants])

    def kinds(col):
        return F.array(*[F.sum((F.col(col)[v] > 0).cast("long")) for v in variants])

    # counts of the grams' suffixes, longest first
    levels = [level]
    for length in range(order, 0, -1):
        level = stored(level.groupBy(F.substring("gram", 2, length).alias("gram"))
                       .agg(summed("a").alias("a"), summed("b").alias("b")), f"url-grams-{length}")
        levels.append(level)
    ratios = None
    for length, level in zip(range(1, order + 2), reversed(levels)):
        context = F.substring("gram", 1, length - 1)
        contexts = (level.groupBy(context.alias("context"))
                    .agg(*[x for c in "ab" for x in (summed(c).alias(f"n{c}"), kinds(c).alias(f"t{c}"))]))
        known = level.withColumn("context", context).join(contexts, "context")
        if ratios is None:
            known = known.withColumns({f"q{c}": F.array_repeat(F.lit(1.0 / ALPHABET), folds + 1) for c in "ab"})
        else:
            known = known.withColumn("shorter", F.substring("gram", 2, length - 1)).join(
                ratios.withColumnRenamed("gram", "shorter"), "shorter")
        # (count + kinds * shorter) / (context + kinds); an unseen context leaves the shorter one's
        def smoothed(c):
            return F.array(*[F.when(F.col(f"n{c}")[v] > 0, (F.col(c)[v] + F.col(f"t{c}")[v] * F.col(f"q{c}")[v])
                                    / (F.col(f"n{c}")[v] + F.col(f"t{c}")[v])).otherwise(F.col(f"q{c}")[v])
                             for v in variants])
        ratios = known.select("gram", smoothed("a").alias("qa"), smoothed("b").alias("qb"))
    return ratios.select("gram", F.array(*[
        F.round((F.log(F.col("qa")[v]) - F.log(F.col("qb")[v])) * NANO).cast("long") for v in variants]).alias("ratio"))


def score_urls(urls: DataFrame, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """(key1, key2, score): mean nanonats per character."""
    ratios = stored(gram_ratios(urls, order, folds), "url-ratios")
    variant = F.when(F.col("label").isNull(), F.lit(folds)).otherwise(F.col("fold"))
    positions = urls.select("key1", "key2", variant.alias("variant"), F.explode(_grams(order)).alias("gram"))
    # frequent n-grams (a scheme, a common host) make large partitions, which AQE's skew join splits
    return (positions.join(ratios, "gram")
            .groupBy("key1", "key2").agg((F.sum(F.col("ratio")[F.col("variant")]) / F.count(F.lit(1))).alias("score")))


def calibrate(labelled: DataFrame, bins: int = 2000) -> DataFrame:
    """One row ``cut``: the score that best separates the classes (highest sum
    of both classes' shares on the right side), from a histogram of a fixed number of
    bins between the least and the greatest score. The cut lies in the middle of the best run of bins."""
    low, high = F.min("score").alias("low"), F.max("score").alias("high")
    ends = labelled.agg(low, high).select("low", F.greatest((F.col("high") - F.col("low")) / bins, F.lit(1.0)).alias("step"))
    at = F.least(F.lit(bins - 1).cast("long"), F.floor((F.col("score") - F.col("low")) / F.col("step")))
    counts = (labelled.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"))
              .agg(F.sum(F.when(F.col("label") == "allow", F.col("copies")).otherwise(0)).alias("a"),
                   F.sum(F.when(F.col("label") == "block", F.col("copies")).otherwise(0)).alias("b")))
    rows = counts.agg(F.array_sort(F.collect_list(F.struct("bin", "a", "b"))).alias("h"))
    total_a = F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x["a"])
    total_b = F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x["b"])
    rows = rows.select("h", total_a.alias("na"), total_b.alias("nb")).where("na > 0 and nb > 0")
    best = F.expr("""
        aggregate(h, named_struct('below_a', 0L, 'below_b', 0L, 'best', -1D, 'lo', 0L, 'hi', 0L, 'open', false),
          (s, x) -> named_struct(
            'below_a', s.below_a + x.a, 'below_b', s.below_b + x.b,
            'best', greatest(s.best, (s.below_b + x.b) / nb + (na - s.below_a - x.a) / na),
            'lo', if((s.below_b + x.b) / nb + (na - s.below_a - x.a) / na > s.best, x.bin + 1, s.lo),
            'hi', if((s.below_b + x.b) / nb + (na - s.below_a - x.a) / na > s.best, x.bin + 1,
                     if(s.open, x.bin, s.hi)),
            'open', (s.below_b + x.b) / nb + (na - s.below_a - x.a) / na > s.best))""")
    return (rows.select(best.alias("s")).crossJoin(F.broadcast(ends))
            .select((F.col("low") + (F.col("s.lo") + F.col("s.hi")) / 2 * F.col("step")).alias("cut")))


def judge_urls(pages: DataFrame, id_col="page_id", url_col="url", rules=RULES, order: int = ORDER,
               folds: int = FOLDS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (nats per character, null for no URL)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    src = pages.select(F.col(id_col).alias("page_id"), url.alias("url"),
                       F.xxhash64(F.lit(1), url).alias("key1"), F.xxhash64(F.lit(2), url).alias("key2"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = src.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "label": verdict})
    urls = stored(ruled.groupBy("key1", "key2").agg(F.first("url").alias("url"), F.first("label").alias("label"),
                                                    F.count(F.lit(1)).alias("copies"))
                  .where(F.col("url") != "")
                  .withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "key1"), F.lit(folds)).cast("int")), "urls")
    scores = stored(score_urls(urls, order, folds), "url-scores")
    cut = calibrate(scores.join(urls.where("label is not null").select("key1", "key2", "label", "copies"), ["key1", "key2"]))
    threshold = F.coalesce(cut.scalar(), F.lit(float("-inf")))
    judged = scores.select("key1", "key2", "score", F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("said"))
    return (ruled.join(judged, ["key1", "key2"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("label", "said", F.lit("allow")).alias("verdict"),
                    (F.col("score") / NANO).alias("score")))
