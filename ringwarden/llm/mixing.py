"""Mixing sources to target weights with soft memberships.

A naive Bayes classifier learned from a labelled table gives every document a
posterior over domains.  Its features are present or absent in a document, and both
count, so a long text is not drawn to a rare domain; a word is a feature only if
it occurs in so many different surroundings that copies of one text cannot make it
one; one temperature, fitted on labelled rows kept apart, calibrates the posteriors.
Nonnegative rates, one a document, are then fitted so that the expected tokens of
each domain, sum(rate * tokens * posterior), match their targets: projected gradient
descent on least squares, in its lazy form: a rate is 1 less the sum of all steps,
projected on what is not negative.  The residuals are measured in the metric of the
documents that are not at rate 0 and a step of a document is not scaled by its length,
so a few steps do and a rate depends on the posterior alone.  A step is one
distributed sum of a few numbers; the driver holds one number a domain, and the rates
are an expression of these.  DataFrame operations only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwarden.llm.text import crc_mod, documents, words
from ringwarden.staging import Staging

#: Labelled rows that the classifier is fitted on, at most (by hash of the id); one in five of them calibrates it.
LABELLED_ROWS = 20_000
#: A feature is so many times as frequent in some domain as it is overall ...
MIN_LIFT = 2.5
#: ... and its log-likelihood ratio is so much above what the best of all candidates shows by chance.
MARGIN = 3.0
#: The most telling features that a document is searched for, at most; the model is a literal of the plan.
FEATURES = 512
#: Temperatures tried in calibration.
TEMPERATURES = [1.0, 0.85, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]
#: Steps of gradient descent, at most; the miss that is left is a column of the result.
STEPS = 60
#: Runs of letters, and runs of other signs.
TOKEN = r"\p{L}+|[^\p{L}\p{N}\s]+"
#: Words of so many letters also count by their first five.
LONG_WORD = 7


@dataclass(frozen=True)
class Model:
    """Domains, log prior of each, log evidence of an empty document, what each present feature adds, temperature."""

    names: list[str]
    prior: list[float]
    base: list[float]
    weights: dict[str, list[float]]
    temperature: float = 1.0


def stem(word: Column) -> Column:
    """The first five letters of a long word, marked; null for a short one."""
    return F.when(F.length(word) >= LONG_WORD, F.concat(F.lit("^"), F.lower(F.substring(word, 1, 5))))


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with n_tokens (runs of letters and of other signs), _tokens, _marks and _features of the column ``text``.

    Features are the distinct tokens, beginnings of long words, and marks of style:
    few different tokens, tokens said twice, repeated lines, capitals.  Step by step, so
    that the optimiser computes each array once.
    """
    read = docs.withColumns({"_tokens": words(F.col("text"), TOKEN), "_lines": F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")})
    read = read.withColumns({"n_tokens": F.size("_tokens").cast("long"), "_seen": F.array_distinct("_tokens"), "_different": F.size(F.array_distinct("_lines")),
                             "_twice": F.size(F.filter(F.arrays_zip("_tokens", F.slice("_tokens", 2, 1 << 30).alias("then")), lambda x: x["_tokens"] == x["then"]))})
    capital = F.size(F.filter("_seen", lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x))))
    marks = [F.when(F.size("_seen") * 4 < F.col("n_tokens"), F.lit("=few")), F.when(F.col("_twice") * 20 > F.col("n_tokens"), F.lit("=twice")),
             F.when(F.col("_different") < F.size("_lines"), F.lit("=lines")), F.when(capital * 2 > F.size("_seen"), F.lit("=capitals"))]
    stems = F.transform(F.filter("_seen", lambda x: F.length(x) >= LONG_WORD), stem)
    read = read.withColumns({"_marks": F.filter(F.array(*marks), lambda m: m.isNotNull()), "_stems": stems})
    read = read.withColumn("_features", F.concat("_seen", F.array_distinct("_stems"), "_marks"))
    return read.drop("_lines", "_seen", "_twice", "_different", "_stems")


def _bounded(labelled: DataFrame) -> DataFrame:
    """The labelled rows that are used, one a doc_id, of conflicting domains the first by name."""
    clean = labelled.select("doc_id", "domain").dropna().groupBy("doc_id").agg(F.min("domain").alias("domain"))
    return clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)


def apart_from_chance(counts: DataFrame, per_domain: dict[str, int], stage: Staging, name: str) -> DataFrame:
    """(feature, ratio): the rows of ``counts(feature, n, n0, n1, ...)`` that tell the domains apart.

    ratio is the log-likelihood ratio of the counts against equal shares in all
    domains; it must exceed what the best of so many features shows by chance.
    """
    total = sum(per_domain.values())
    share = [n / total for n in per_domain.values()]

    def term(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    ratio = reduce(Column.__add__, [term(F.col(f"n{k}"), F.col("n") * s) + term(n - F.col(f"n{k}"), (total - F.col("n")) * s)
                                    for k, (n, s) in enumerate(zip(per_domain.values(), share))])
    lift = F.greatest(F.lit(0.0), *[F.col(f"n{k}") / F.col("n") / s for k, s in enumerate(share)])
    tried = stage.save(counts.where(f"n >= 5 and n < {total}").select("feature", ratio.alias("ratio"), lift.alias("lift")), name)
    least = math.log(max(tried.count(), 1)) + MARGIN
    return tried.where((F.col("lift") >= MIN_LIFT) & (F.col("ratio") >= least)).select("feature", "ratio")


def telling_features(seen: DataFrame, per_domain: dict[str, int], stage: Staging) -> list[str]:
    """The features that tell domains apart, both by documents and by the different surroundings that they have in each.

    A surrounding is the token with its neighbours where a feature first stands in a text.
    """
    def counted(rows: DataFrame) -> DataFrame:
        each = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(per_domain)]
        return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *each)

    by_document = apart_from_chance(counted(seen.select("domain", F.explode("_features").alias("feature"))), per_domain, stage, "by-document")
    held = F.broadcast(by_document.select("feature"))  # of at most LABELLED_ROWS texts
    tokens = seen.select("doc_id", "domain", F.col("_tokens").alias("w"))
    around = F.transform("w", lambda x, i: F.struct(x.alias("token"), F.xxhash64(F.get("w", i - 1), x, F.get("w", i + 1)).alias("around")))
    places = tokens.select("doc_id", "domain", F.posexplode(around).alias("pos", "t")).select("doc_id", "domain", "pos", "t.*")
    features = places.select("doc_id", "domain", "pos", "around", F.explode(F.array("token", stem(F.col("token")))).alias("feature")).join(held, "feature")
    at = F.col("pos") * 2 ** 32 + F.pmod("around", F.lit(2 ** 32))  # the first place decides
    once = features.groupBy("doc_id", "domain", "feature").agg(F.min(at).alias("at")).select("domain", "feature", F.pmod("at", F.lit(2 ** 32)).alias("context"))
    marks = seen.select("domain", F.explode("_marks").alias("feature"), F.xxhash64("doc_id").alias("context")).join(held, "feature").select("domain", "feature", "context")
    top = apart_from_chance(counted(once.unionByName(marks).distinct()), per_domain, stage, "by-surrounding")
    return [r["feature"] for r in top.orderBy(F.desc("ratio"), "feature").limit(FEATURES).collect()]


def fit_domains(docs: DataFrame, labelled: DataFrame, stage: Staging) -> Model:
    """The classifier learned from ``labelled(doc_id, domain)``; four in five of its rows give counts, the others the temperature."""
    mine = docs.select("doc_id", "text").join(F.broadcast(_bounded(labelled)), "doc_id")  # at most LABELLED_ROWS ids
    seen = stage.save(with_features(mine).drop("text"), "labelled")
    apart = crc_mod(F.col("doc_id"), 5) == 4
    learn = seen.where(~apart)
    rows = learn.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
    per_domain = {r["domain"]: r["n"] for r in sorted(rows, key=lambda r: r["domain"])}
    names, total = list(per_domain), sum(per_domain.values())
    if not names:
        return Model([], [], [], {})
    found = telling_features(learn, per_domain, stage)
    prior = [math.log(per_domain[d] / total) for d in names]
    base, weights = [0.0] * len(names), {}
    if found:
        has = learn.select("domain", F.explode(F.array_intersect("_features", F.array(*[F.lit(x) for x in found]))).alias("feature"))
        sums = has.groupBy("feature").agg(*[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(names)])
        for r in sums.orderBy("feature").collect():  # at most FEATURES rows
            n = [r[f"n{k}"] for k in range(len(names))]
            share = [(n[k] + (sum(n) + 1) / (total + 2)) / (per_domain[d] + 1) for k, d in enumerate(names)]
            base = [b + math.log(1 - p) for b, p in zip(base, share)]
            weights[r["feature"]] = [math.log(p / (1 - p)) for p in share]
    model = Model(names, prior, base, weights)
    own = F.array_position(F.array(*[F.lit(d) for d in names]), F.col("domain")).cast("int")
    scored = evidence(seen.where(apart).where(F.col("domain").isin(names)), model).select(own.alias("own"), *[f"_s{k}" for k in range(len(names))])
    fits = []
    for i, t in enumerate(TEMPERATURES):
        chance = F.element_at(F.array(*softened(replace(model, temperature=t))), F.col("own"))
        fits.append(F.sum(F.log(F.greatest(chance, F.lit(1e-12)))).alias(f"t{i}"))
    row = scored.agg(*fits).first()
    best = max(range(len(TEMPERATURES)), key=lambda i: row[f"t{i}"] if row[f"t{i}"] is not None else -i)
    return replace(model, temperature=TEMPERATURES[best])


def evidence(featured: DataFrame, model: Model) -> DataFrame:
    """``featured(_features, ...)`` with _s0, _s1, ...: what features present and absent say for each domain, as log-likelihoods."""
    known = F.array(*[F.lit(x) for x in model.weights]).cast("array<string>")
    added = F.array(*[F.array(*[F.lit(float(w)) for w in v]) for v in model.weights.values()]).cast("array<array<double>>")
    table = F.map_from_arrays(known, added)
    met = featured.withColumn("_met", F.transform(F.array_intersect("_features", known), lambda x: F.element_at(table, x)))
    return met.withColumns({f"_s{k}": _score(k, b) for k, b in enumerate(model.base)}).drop("_met")


def _score(k: int, base: float) -> Column:
    return F.aggregate("_met", F.lit(float(base)), lambda a, x: a + x[k])


def softened(model: Model) -> list[Column]:
    """Posteriors of the domains from _s0, _s1, ..."""
    raw = [F.col(f"_s{k}") * model.temperature + float(p) for k, p in enumerate(model.prior)]
    return [1 / reduce(Column.__add__, [F.exp(F.least(other - own, F.lit(700.0))) for other in raw]) for own in raw]


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` with n_tokens and p, the posteriors of the model's domains."""
    scored = evidence(with_features(docs), model)
    return scored.withColumn("p", F.array(*softened(model))).select(*[f"`{c}`" for c in docs.columns if c not in ("n_tokens", "p")], "n_tokens", "p")


def fit_rates(soft: DataFrame, targets: np.ndarray, tolerance: float = 1e-9) -> tuple[Column, float]:
    """(rate of each row of ``soft(n_tokens, p)``, miss): nonnegative, expected domain tokens nearest to ``targets``.

    The miss is the largest difference to a target, as a share of all; it is above
    ``tolerance`` only if nonnegative rates can't meet the targets or STEPS are over.
    """
    d = len(targets)
    p = [F.col("p")[k] for k in range(d)]
    total, best, pull, stride = max(float(targets.sum()), 1.0), (float("inf"), np.zeros(d)), np.zeros(d), 1.0
    step = np.zeros(d)

    def rate(weight: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - reduce(Column.__add__, [p[k] * float(weight[k]) for k in range(d)]))

    for _ in range(STEPS):
        now = soft.select(F.col("n_tokens").alias("t"), *[p[k].alias(f"p{k}") for k in range(d)], rate(pull).alias("r"))
        sums = [F.sum(F.expr(f"t * r * p{k}")).alias(f"g{k}") for k in range(d)]
        sums += [F.sum(F.expr(f"if(r > 0, t * p{i} * p{j}, 0)")).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]
        row = now.agg(*sums).first()
        off = np.array([row[f"g{k}"] or 0.0 for k in range(d)]) - targets
        miss = float(np.abs(off).max() / total)
        if miss < best[0]:
            best, stride = (miss, pull), min(1.0, 2 * stride)
            metric = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
            step = np.linalg.pinv(metric, rcond=1e-12) @ off
        else:  # too far: half the way from the best point
            stride /= 2
        if miss <= tolerance or stride < 1e-3:
            break
        pull = best[1] + stride * step
    return rate(best[1]), best[0]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], only_less: bool = False) -> DataFrame:
    """Add n_tokens, p, domain, posterior, rate and miss to the rows of ``docs``.

    ``labelled`` is (doc_id, domain); rows with a null in either are ignored, of a
    doc_id with several domains the first by name is used.  ``weights`` are the
    wanted shares of expected tokens; a learned domain without a weight gets 0, a
    weight without a learned domain is left out and the rest scaled to 1.  The sum of
    tokens stays as it is; with ``only_less`` the domain of the largest weight keeps
    its tokens, others above their share of it fall to that, and those below stay.
    p lists the posteriors of the learned domains in the order of their names; miss
    tells how far the expected shares are from the targets.  Null or empty texts have
    no tokens and are judged by the absence of all features; very long texts are read
    whole; with nothing to learn from, or no tokens at all, every rate is 1 and the
    domain null.  Repeated rows and ids are rated by their own texts; columns of
    ``docs`` with one of the added names are replaced; an empty table gives an empty result.
    """
    stage = Staging(docs.sparkSession)
    model = fit_domains(docs, labelled, stage)
    names = model.names
    want = np.array([max(0.0, float(weights.get(d, 0))) for d in names])
    kept = [f"`{c}`" for c in docs.columns if c not in ("n_tokens", "p", "domain", "posterior", "rate", "miss")]
    if not names or want.sum() == 0:
        return docs.select(*kept, F.size(words(F.col("text"), TOKEN)).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("p"),
                           F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(0.0).alias("miss"))
    soft = stage.save(posteriors(docs, model), "posteriors")
    want /= want.sum()
    main = int(want.argmax())
    mass = soft.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("p")[k]), F.lit(0.0)).alias(f"m{k}") for k in range(len(names))]).first()
    mass = np.array([float(x) for x in mass])
    targets = np.minimum(want * mass[main] / want[main], mass) if only_less else want * mass.sum()
    rate, miss = fit_rates(soft, targets) if mass.sum() > 0 else (F.lit(1.0), 0.0)
    top = F.array_position("p", F.array_max("p"))
    return soft.select(*kept, "n_tokens", "p", F.element_at(F.array(*[F.lit(d) for d in names]), top.cast("int")).alias("domain"),
                       F.array_max("p").alias("posterior"), rate.alias("rate"), F.lit(miss).alias("miss"))


def label_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) from the labels table: q<quality>t<toxic>."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    name = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    return labels.select("doc_id", name.alias("domain"))


#: Wanted shares of tokens of the registered query.
WEIGHTS = {"q1t0": 0.9, "q0t0": 0.07, "q1t1": 0.02, "q0t1": 0.01}


def op3_mix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every document for the target shares of the labelled domains, with its posteriors."""
    out = mix(documents(spark, sf_dir).select("doc_id", "text"), label_domains(spark, sf_dir), WEIGHTS)
    return out.select("doc_id", "n_tokens", "p", "domain", "posterior", "rate", "miss")
