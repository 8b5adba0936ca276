"""Classification metrics, nearest-rank percentiles, word error rate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwarden.functions.scalar import duplicate_key


def length_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, min, p5, p50, p95, max, mean) of a column: nearest ranks, the mean with one decimal; nulls are left out."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 1).alias("mean"))
    ranks = nearest_rank(df, keys, value, [0.05, 0.5, 0.95])
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return ends.alias("a").join(ranks.alias("b"), same).select(*[f"a.{k}" for k in keys], "n", "min", "p5", "p50", "p95", "max", "mean")


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Per key the values at 0-based place ``min(n - 1, floor(q * n))`` of the sorted column, as p<q in percent>.

    A histogram of distinct values is ranked by running counts, so equal values
    are one row.
    """
    from pyspark.sql import Window

    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = (hist.withColumn("_end", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys))))
    place = lambda q: F.least(F.col("_all") - 1, F.floor(F.lit(q) * F.col("_all")))
    pick = [F.min(F.when(F.col("_end") > place(q), F.col(value))).alias(f"p{round(q * 100)}") for q in quantiles]
    return run.groupBy(*keys).agg(*pick)


def confusion(df: DataFrame, groupings: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Counts and rates overall and by each grouping column, in one pass of grouping sets.

    A rate whose denominator is 0 is 0, the rates of a class that does not occur
    are null, macro_f1 is null unless both classes occur; rates have 4 decimals.
    """
    y, z = F.col(label), F.col(predicted)
    sets = [[]] + [[g] for g in groupings]
    sums = [F.count_if((y == 0) & (z == 0)).alias("tn"), F.count_if((y == 0) & (z == 1)).alias("fp"),
            F.count_if((y == 1) & (z == 0)).alias("fn"), F.count_if((y == 1) & (z == 1)).alias("tp")]
    out = df.groupingSets(sets, *groupings).agg(*sums, F.grouping_id().alias("_g"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f = lambda hit, wrong, missed: F.when(hit + missed > 0, rate(2 * hit, 2 * hit + wrong + missed))
    f1, f0 = f(tp, fp, fn), f(tn, fn, fp)
    return out.select(*groupings, "tn", "fp", "fn", "tp", F.round((tp + tn) / (tp + tn + fp + fn), 4).alias("accuracy"),
                      F.when(tp + fn > 0, F.round(rate(tp, tp + fp), 4)).alias("precision_1"), F.when(tp + fn > 0, F.round(rate(tp, tp + fn), 4)).alias("recall_1"),
                      F.round(f1, 4).alias("f1_1"), F.round(f0, 4).alias("f1_0"), F.round((f1 + f0) / 2, 4).alias("macro_f1"))


def risk_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by label and level, and what the score, the model alone and the rules alone miss and flag wrongly.

    ``df`` holds label (0 or 1), level, probability, flagged and capped.  A level above
    LOW, a probability from 0.5 and a flag are detections.  Rates have 4 decimals and
    are null without a denominator; f1 comes from the rounded rates, null if one is 0.
    """
    bad, fine = F.col("label") == 1, F.col("label") == 0
    out = [F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("scam"), F.count_if(fine).alias("normal"), F.count_if("capped").alias("capped")]
    out += [F.count_if(c & (F.col("level") == x)).alias(f"{n}_{x.lower()}") for n, c in (("scam", bad), ("normal", fine)) for x in ("HIGH", "MEDIUM", "LOW")]
    for name, said in (("model", F.col("probability") >= 0.5), ("rules", F.col("flagged"))):
        out += [F.count_if(bad & ~said).alias(f"{name}_missed"), F.count_if(fine & said).alias(f"{name}_flagged")]
    n = df.groupBy(*keys).agg(*out)
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    caught, wrong = F.col("scam") - F.col("scam_low"), F.col("normal") - F.col("normal_low")
    n = n.withColumns({"precision": ratio(caught, caught + wrong), "recall": ratio(caught, F.col("scam")), "accuracy": ratio(caught + F.col("normal_low"), F.col("rows")),
                       "model_accuracy": ratio(F.col("rows") - F.col("model_missed") - F.col("model_flagged"), F.col("rows"))})
    p, r = F.col("precision"), F.col("recall")
    return n.withColumn("f1", F.when((p > 0) & (r > 0), F.round(2 * p * r / (p + r), 4)))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression used inside a lambda would be computed at every place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """The least number of substituted, deleted and inserted words between two arrays of words.

    Each different word of the two becomes a character of its own, in the order of
    first use, and the edit distance of the two texts of such characters is the
    answer; there are over a million characters to give.
    """
    def distance(pair: Column, words: Column) -> Column:
        point = lambda w: F.array_position(words, w) + 255
        sign = lambda w: F.lpad(F.hex(F.when(point(w) < 0xD800, point(w)).otherwise(point(w) + 0x800)), 8, "0")
        coded = lambda a: F.decode(F.unhex(F.array_join(F.transform(a, sign), "")), "UTF-32")
        return F.levenshtein(coded(pair["r"]), coded(pair["h"]))

    both = F.struct(reference.alias("r"), hypothesis.alias("h"))
    return _with(both, lambda p: _with(F.array_distinct(F.concat(p["r"], p["h"])), lambda v: distance(p, v)))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word errors over the number of reference words; null if there is no reference word, a null hypothesis has no words."""
    none = F.array().cast("array<string>")
    words = lambda t: F.filter(F.coalesce(F.split(duplicate_key(t), " "), none), lambda w: w != "")
    both = F.struct(words(reference).alias("r"), words(hypothesis).alias("h"))
    return _with(both, lambda p: F.when(F.size(p["r"]) > 0, word_errors(p["r"], p["h"]) / F.size(p["r"])))


def mean_word_error(files: DataFrame, keys: list[str], wer: str = "wer") -> DataFrame:
    """(keys, files, with_reference, mean_wer): files without a rate count as files alone; the mean has 4 decimals, null without any."""
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.count(wer).alias("with_reference"), F.round(F.avg(wer), 4).alias("mean_wer"))
