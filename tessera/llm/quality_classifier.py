"""Quality classifier: document evidence combined with host and path posteriors.

Two targets, ``toxic`` and ``low`` (quality 0), each get a ridge-penalised logistic model over words and
layout marks that are significantly more frequent in the target class. The labelled
sample for the fit is bounded by about ``max_labelled`` documents, chosen by a hash of the id; the driver sees no text
of it, only which of at most ``MAX_FEATURES`` features each document has. Every
document is then scored; grouped aggregation of the scores gives each host and each path
below it a beta posterior, a sparse path shrinking to its host and a sparse
host to the global rate. The strength of either prior, in documents, is estimated from the scores by moments: the variance within
groups over the variance between their true means. A document's own score is left out of its site's posterior. Its
log odds are shifted by its path's log odds against the global ones, and it is kept if both probabilities stay below ``REJECT``.

Nulls: a null text is scored as empty; a null host or path forms its own site.
Labels that are null are ignored; with no labels nothing is rejected. Repeated rows are scored
alike and count each. An empty table gives no rows. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, group_key, staged, without

TARGETS = ("toxic", "low")
SITE = ("n", "hn", "h_toxic", "h_low", "s_toxic", "s_low")
OUTPUT = ("p_toxic", "p_low", "kept")
MAX_LABELLED = 20_000
MIN_SEEN, MIN_Z, MAX_FEATURES = 6, 4.0, 2_000
RIDGE, ROUNDS, REJECT = 0.03, 400, 0.15
#: The least and the most documents that a fitted prior may count for.
STRENGTH = (1.0, 1e6)
WORD = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[#*$%&|<>]")


def features(text: str | None) -> set[str]:
    """Distinct lower-cased letter runs and a few layout marks (upper-case names, so no word is one)."""
    text = text or ""
    runs = WORD.findall(text.lower())
    found = set(runs)
    n = max(1, len(text.split()))
    step = lambda x: min(9, int(x * 10))
    upper = sum(map(str.isupper, text)) / max(1, len(text))
    marks = {f"SYMBOLS{step(len(MARKS.findall(text)) / n)}", f"UPPER{step(2 * upper)}"}
    if n >= 40:
        marks.add(f"DISTINCT{step(math.sqrt(n) * len(found) / n / 10)}")
        marks.add(f"TOP{step(max(Counter(runs).values(), default=0) / n)}")
    return found | marks


def logistic(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Weights and, last, the intercept of a model over the set cells ``(rows, columns)`` of a 0/1 matrix.

    Full gradients with a step size per weight; only the weights are penalised.
    """
    rate = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    w = np.append(np.zeros(width), math.log(rate / (1 - rate)))
    squares = np.full(width + 1, 1e-12)
    for _ in range(ROUNDS):
        odds = np.bincount(rows, weights=w[columns], minlength=len(y)) + w[-1]
        off = 1 / (1 + np.exp(-odds)) - y
        slope = np.append(np.bincount(columns, weights=off[rows], minlength=width) + RIDGE * w[:-1], off.sum())
        squares += slope**2
        w -= 0.5 * slope / np.sqrt(squares)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int) -> dict[str, tuple[float, dict[str, float]]]:
    """For each target the intercept and the weight of each feature."""
    known = labels.where("quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max((F.col("quality") == 0).cast("int")).alias("low"))
    n = known.count()
    if not n:
        return {t: (-20.0, {}) for t in TARGETS}
    share = min(1.0, max_labelled / n)
    chosen = known.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {k: Counter() for k in ("n", *TARGETS)}
        for pdf in batches:
            for text, toxic, low in zip(pdf["text"], pdf["toxic"], pdf["low"]):
                found = features(text) | {""}
                seen["n"].update(found)
                if toxic:
                    seen["toxic"].update(found)
                if low:
                    seen["low"].update(found)
        names = list(seen["n"])
        for at in range(0, len(names), 10_000):
            part = names[at : at + 10_000]
            yield pd.DataFrame({"feature": pd.Series(part, dtype=object), **{k: [c[f] for f in part] for k, c in seen.items()}})

    sums = (
        rows.mapInPandas(count, "feature string, n long, toxic long, low long")
        .groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
        .where(F.col("n") >= MIN_SEEN)
    )
    sums = staged(sums, "evidence")
    total = sums.where("feature = ''").first()
    models, chosen_features = {}, {}
    for t in TARGETS:
        if total is None or not 0 < total[t] < total["n"]:
            models[t] = (-20.0 if total is None or not total[t] else 20.0, {})
            continue
        n, rate = float(total["n"]), float(total[t]) / total["n"]
        z = (F.col(t) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) * (1 - F.col("n") / (n + 1)))
        best = sums.where("feature <> ''").withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
        chosen_features[t] = {r["feature"]: k for k, r in enumerate(best.select("feature").collect())}

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [features(text) for text in pdf["text"]]
            has = {t: [sorted(known[f] for f in fs if f in known) for fs in found] for t, known in chosen_features.items()}
            yield pdf[["doc_id", *TARGETS]].assign(**{f"has_{t}": has.get(t, [[]] * len(pdf)) for t in TARGETS})

    if chosen_features:
        schema = "doc_id long, toxic int, low int, has_toxic array<int>, has_low array<int>"
        # an id that several rows have counts once here
        sample = rows.select(F.col("doc_id").cast("long"), "text", *[F.col(t).cast("int") for t in TARGETS]).mapInPandas(cells, schema)
        sample = sample.groupBy("doc_id").agg(*[F.max(t).alias(t) for t in TARGETS], *[F.min(f"has_{t}").alias(f"has_{t}") for t in TARGETS])
        sample = sorted(sample.collect(), key=lambda r: r["doc_id"])
    for t, known in chosen_features.items():
        at = np.repeat(np.arange(len(sample)), [len(r[f"has_{t}"]) for r in sample])
        columns = np.array([k for r in sample for k in r[f"has_{t}"]], dtype=np.int64)
        w = logistic(at, columns, np.array([float(r[t]) for r in sample]), len(known))
        models[t] = (float(w[-1]), {f: float(w[k]) for f, k in known.items()})
    discard(sums)
    return models


def scores(docs: DataFrame, models: dict, text_col: str) -> DataFrame:
    """Adds ``odds_toxic`` and ``odds_low``, the log odds from the text alone."""

    @F.pandas_udf("odds_toxic double, odds_low double")
    def score(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = features(text)
            row = []
            for t in TARGETS:
                prior, weights = models[t]
                row.append(max(-30.0, min(30.0, prior + sum(weights.get(f, 0.0) for f in found))))
            out.append(row)
        return pd.DataFrame(out, columns=["odds_toxic", "odds_low"], dtype="float64")

    return docs.withColumn("odds", score(F.col(text_col))).select("*", "odds.*").drop("odds")


def strength(groups: DataFrame, keys: list[str], target: str) -> float:
    """Documents that the prior of groups counts for: variance within groups over variance between them.

    ``groups`` holds for each group (and perhaps more finely) the number ``n`` of documents, the sum and the sum of squares of their
    scores; the groups of ``keys`` are compared. One row of sums reaches the driver.
    """
    by = groups.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(target).alias("s"), F.sum(f"{target}_2").alias("q"))
    n, s = F.col("n"), F.col("s")
    r = by.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(s * s / n).alias("between")).first()
    if not r["n"] or r["n"] <= r["groups"] or r["groups"] < 2:
        return STRENGTH[1]
    within = max(0.0, r["q"] - r["between"]) / (r["n"] - r["groups"])
    true = (r["between"] - r["s"] ** 2 / r["n"] - (r["groups"] - 1) * within) / (r["n"] - r["nn"] / r["n"])
    return min(STRENGTH[1], max(STRENGTH[0], within / true)) if true > 0 else STRENGTH[1]


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    max_labelled: int = MAX_LABELLED, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``p_toxic, p_low, kept``; the scored rows are staged in the shared folder."""
    docs = without(docs, (*OUTPUT, "odds", "odds_toxic", "odds_low", "host_", "path_", *SITE))
    models = train(docs, labels, id_col, text_col, max_labelled)
    scored = scores(docs, models, text_col)
    scored = staged((scored if keep_text else scored.drop(text_col)).withColumns({"host_": group_key(host_col), "path_": group_key(path_col)}), "scored")
    out = with_posteriors(scored)
    out = out.withColumn("kept", (F.col("p_toxic") < REJECT) & (F.col("p_low") < REJECT))
    return out.drop("host_", "path_", *[f"odds_{t}" for t in TARGETS])


def with_posteriors(scored: DataFrame) -> DataFrame:
    """``scored(host_, path_, odds_toxic, odds_low, ...)`` with ``p_toxic, p_low``."""
    p = lambda t: 1 / (1 + F.exp(-F.col(f"odds_{t}")))
    sums = [f(x).alias(name) for t in TARGETS for name, x, f in ((t, p(t), F.sum), (f"{t}_2", p(t) * p(t), F.sum))]
    paths = staged(scored.groupBy("host_", "path_").agg(F.count("*").alias("n"), *sums), "sites")
    world = paths.agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    hosts = paths.groupBy("host_").agg(F.sum("n").alias("hn"), *[F.sum(t).alias(f"h_{t}") for t in TARGETS])
    sites = staged(paths.join(hosts, "host_").drop(*[f"{t}_2" for t in TARGETS]).withColumnsRenamed({t: f"s_{t}" for t in TARGETS}), "posteriors")
    out, odds = scored.join(sites, ["host_", "path_"]), lambda x: F.log(x / (1 - x))
    for t in TARGETS:
        rate = min(1 - 1e-6, max(1e-6, (world[t] or 0.0) / max(1, world["n"] or 0)))
        k_host, k_path = strength(paths, ["host_"], t), strength(paths, ["host_", "path_"], t)
        # the document itself says nothing about its site here
        host = (F.col(f"h_{t}") - p(t) + k_host * rate) / (F.col("hn") - 1 + k_host)
        path = (F.col(f"s_{t}") - p(t) + k_path * host) / (F.col("n") - 1 + k_path)
        path = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), path))
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(f"odds_{t}") + odds(path) - F.lit(math.log(rate / (1 - rate)))))))
    discard(paths)
    return out.drop(*SITE)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, keep_text=False).select("doc_id", "source", "lang", *OUTPUT)
