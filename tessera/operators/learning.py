"""Features of answers and the model of answer quality."""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col, words

# fixed values: the features in the order models read them
FEATURES = (
    "hallucination_score", "risk_score", "retrieved_context_count", "n_claims", "n_entailed", "n_baseless", "n_contradicted",
    "frac_entailed", "n_sources", "answer_len_words", "unverified_flag",
)


def answer_features(df: DataFrame, *, score: Column, risk: Column, level: Column, contexts: Column, verdicts: Column, sources: Column, answer: Column | str) -> DataFrame:
    """``df`` with the columns of ``FEATURES``.

    An unreadable score counts as 2; a missing risk score falls back to its level (low 0, medium 1, else 2); a missing
    number of contexts to that of sources. Unknown verdicts count as claims only.
    """
    # one pass over the verdicts, read by the features below
    tally = lambda v: F.struct(F.size(v).alias("n"), *(F.size(F.filter(v, lambda x: F.lower(x) == k)).alias(k) for k in ("entailed", "baseless", "contradicted")))  # noqa: E731,B023
    rows = df.withColumn("__c", F.transform(F.array(F.coalesce(verdicts, F.array().cast("array<string>"))), tally)[0]).withColumn("__sources", sources)
    n, count = F.col("__c.n"), lambda name: F.col(f"__c.{name}")
    sources = F.col("__sources")
    lv = F.lower(F.trim(level))
    text = F.coalesce(col(answer), F.lit(""))
    out = {
        "hallucination_score": F.coalesce(score, F.lit(2)),
        "risk_score": F.coalesce(risk, F.when(lv == "low", 0).when(lv == "medium", 1).otherwise(2)),
        "retrieved_context_count": F.coalesce(contexts, sources, F.lit(0)),
        "n_claims": n, "n_entailed": count("entailed"), "n_baseless": count("baseless"), "n_contradicted": count("contradicted"),
        "frac_entailed": F.when(n > 0, count("entailed") / n).otherwise(0.0),
        "n_sources": F.coalesce(sources, F.lit(0)), "answer_len_words": F.size(words(text)),
        "unverified_flag": F.contains(F.lower(text), F.lit("could not verify")).cast("int"),
    }
    return rows.withColumns({k: c.cast("double") for k, c in out.items()}).drop("__c", "__sources")


SPLIT_BUCKETS = 1 << 12


def split_by_class(df: DataFrame, key: str, label: str, share: float = 0.25, seed: int = 42) -> DataFrame:
    """``df`` with ``held_out``: of each class exactly the rounded ``share`` of its rows, those of the lowest seeded hashes.

    Two passes of counts find the hash at which a class is cut: first over coarse buckets of the hash, then within the
    one bucket in question; the rows themselves aren't ranked. Rows of one key and class have one hash and stay
    together, so repeated keys can move the cut by their number. Null labels are a class of their own.
    """
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(label)), F.lit(1 << 52))
    bucket = F.floor(h / F.lit((1 << 52) // SPLIT_BUCKETS))
    rows = df.select(F.col(label).alias("l"), h.alias("h"), bucket.alias("b"))
    counts: dict = {}
    for r in rows.groupBy("l", "b").agg(F.count("*").alias("n")).orderBy("l", "b").collect():  # classes times buckets
        counts.setdefault(r["l"], []).append((r["b"], r["n"]))
    cutoff = F.lit(-1).cast("long")
    for value, per in counts.items():
        left = int(sum(n for _, n in per) * share + 0.5)
        at = next((k for k, s in enumerate(accumulate(n for _, n in per)) if s >= left), 0)
        left -= sum(n for _, n in per[:at])
        same = F.col("l").eqNullSafe(F.lit(value))
        edge = rows.where(same & (F.col("b") == per[at][0])).orderBy("h").limit(left).agg(F.max("h")).first()[0] if left > 0 else None
        if edge is not None:
            cutoff = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(edge)).otherwise(cutoff)
    return df.withColumn("held_out", h <= cutoff)


def quality_model(train: DataFrame, label: str, features: tuple[str, ...] = FEATURES, *, trees: bool = False, c: float = 1.0) -> PipelineModel:
    """Standardised features and logistic regression with balanced classes, or boosted trees. Nulls count as 0."""
    n = train.groupBy(label).agg(F.count("*").alias("n")).collect()  # one row per class
    total = sum(r["n"] for r in n)
    weight = F.lit(0.0)
    for r in n:
        weight = F.when(F.col(label) == r[label], total / (len(n) * r["n"])).otherwise(weight)
    rows = train.na.fill(0, list(features)).withColumn("__w", weight)
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="__raw")]
    if trees:
        stages.append(GBTClassifier(featuresCol="__raw", labelCol=label, seed=42))
    else:
        stages += [
            StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
            LogisticRegression(featuresCol="__x", labelCol=label, weightCol="__w", maxIter=1000, regParam=1 / (c * max(total, 1)), standardization=False),
        ]
    return Pipeline(stages=stages).fit(rows)


def coefficients(model: PipelineModel, features: tuple[str, ...] = FEATURES) -> list[tuple[str, float]]:
    """Weights or importances by size, largest first."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return sorted(((f, round(float(v), 4)) for f, v in zip(features, values.toArray())), key=lambda x: -abs(x[1]))


def predict_quality(model: PipelineModel, df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``df`` with ``quality``, the probability of class 1."""
    out = model.transform(df.na.fill(0, list(features)))
    return out.withColumn("quality", vector_to_array("probability")[1]).select(*df.columns, "quality")


def auc(scored: DataFrame, label: str, score: str, ranges: int = 1024) -> DataFrame:
    """``(auc)``, exactly, by average ranks.

    Counts per distinct score first; their running sums then come in two levels (ranges of the score, and within each),
    so that neither ties nor many distinct scores meet in one task.
    """
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    per = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(n1.alias("p"), n0.alias("n"))
    ends = per.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    place = F.coalesce(F.floor(F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")) * ranges), F.lit(0))
    per = per.crossJoin(F.broadcast(ends)).select("s", "p", "n", place.alias("r"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    base = per.groupBy("r").agg(F.sum("n").alias("m")).select("r", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    wins = per.join(F.broadcast(base), "r").withColumn("w", F.col("p") * (below + F.col("n") / 2))
    return wins.agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("n")).alias("auc"))


def binary_metrics(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """``(n, accuracy, majority, precision, recall, f1, tp, fp, fn, tn)``."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    m = scored.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    pos = F.col("tp") + F.col("fn")
    m = m.withColumn("n", n).withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), n)).withColumn("majority", F.try_divide(F.greatest(pos, n - pos), n))
    m = m.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", pos), F.lit(0.0)))
    return m.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def cross_validated_auc(df: DataFrame, key: str, label: str, features: tuple[str, ...] = FEATURES, folds: int = 5, seed: int = 42, **options) -> list[float]:
    """AUC of each fold of a hash-stratified cross-validation; a fold of one class has none (None)."""
    rows = df.withColumn("__f", F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(label)), F.lit(folds))).persist()
    out = []
    for k in range(folds):
        model = quality_model(rows.where(F.col("__f") != k), label, features, **options)
        value = auc(predict_quality(model, rows.where(F.col("__f") == k), features), label, "quality").first()[0]
        out.append(value)
    rows.unpersist()
    return out


def training_report(df: DataFrame, key: str, label: str, features: tuple[str, ...] = FEATURES, *, path: str | None = None, seed: int = 42, **options) -> DataFrame:
    """One row of metrics of the model fitted on three quarters of each class and judged on the rest.

    ``(n, n_train, n_test, positive_rate, accuracy, majority, roc_auc, precision, recall, f1, tp, fp, fn, tn,
    cv_auc_mean, cv_auc_std)``; the deviation is that of the folds themselves. With ``path`` a model of all rows is
    saved there. ``options`` go to ``quality_model``.
    """
    rows = split_by_class(df, key, label, seed=seed).persist()
    judged = predict_quality(quality_model(rows.where("NOT held_out"), label, features, **options), rows.where("held_out"), features)
    folds = [x for x in cross_validated_auc(df, key, label, features, seed=seed, **options) if x is not None]
    mean = sum(folds) / len(folds) if folds else None
    deviation = (sum((x - mean) ** 2 for x in folds) / len(folds)) ** 0.5 if folds else None
    sizes = rows.agg(F.count("*").alias("n_all"), F.count_if(~F.col("held_out")).alias("n_train"), F.avg(F.col(label)).alias("positive_rate"))
    area = auc(judged, label, "quality").select(F.col("auc").alias("roc_auc"))
    out = binary_metrics(judged, label, "quality").withColumnRenamed("n", "n_test").crossJoin(F.broadcast(area)).crossJoin(F.broadcast(sizes))  # one row each
    if path:
        quality_model(df, label, features, **options).write().overwrite().save(path)
    return out.withColumnsRenamed({"n_all": "n"}).withColumns({"cv_auc_mean": F.lit(mean).cast("double"), "cv_auc_std": F.lit(deviation).cast("double")})
