"""Models on Spark ML: candidates, calibration, ensembles, cross-validation by hash folds, controls."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from .curves import calibration, rank_metrics
from .explain import logistic


def clip(p: Column, e: float = 1e-7) -> Column:
    return F.least(F.greatest(p, F.lit(e)), F.lit(1 - e))


def logit(p: Column) -> Column:
    p = clip(p)
    return F.log(p / (1 - p))


def candidates(n_features: int, seed: int = 42) -> dict[str, object]:
    """The grid of classifiers by name."""
    out: dict[str, object] = {f"logistic_{c}": LogisticRegression(regParam=1.0 / (c * 1000), maxIter=50, standardization=False) for c in (0.1, 1.0)}
    out["logistic_balanced"] = LogisticRegression(regParam=1e-3, weightCol="weight", maxIter=50, standardization=False)
    out["forest"] = RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed)
    out["boosted"] = GBTClassifier(maxIter=10, maxDepth=4, seed=seed)
    out["mlp"] = MultilayerPerceptronClassifier(layers=[n_features, 16, 8, 2], maxIter=40, seed=seed)
    return out


def prepared(df: DataFrame, features: tuple[str, ...], label: str = "label") -> DataFrame:
    """label as double, and weights that make classes count alike."""
    n = df.agg(F.avg(F.col(label).cast("double")).alias("p"))
    w = F.when(F.col(label) == 1, 0.5 / F.col("p")).otherwise(0.5 / (1 - F.col("p")))
    return df.crossJoin(F.broadcast(n)).withColumn("weight", w).withColumn("label", F.col(label).cast("double")).drop("p").na.fill(0.0, list(features))


def fit(df: DataFrame, features: tuple[str, ...], classifier) -> object:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), classifier]).fit(df)


def scored(model, df: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def dummy(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.lit(0.0))


def ensemble(models: list, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean score of the members and the decision at the threshold."""
    for i, m in enumerate(models):
        df = scored(m, df, f"member_{i}")
    mean = sum((F.col(f"member_{i}") for i in range(1, len(models))), F.col("member_0")) / len(models)
    return df.withColumn("score", mean).withColumn("predicted", (mean >= threshold).cast("int"))


def importances(model, features: tuple[str, ...]) -> dict[str, float]:
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return dict(zip(features, (float(v) for v in values), strict=True))


def expression(model, features: tuple[str, ...]):
    """A logistic model as a scorer of columns."""
    last = model.stages[-1]
    return logistic(dict(zip(features, (float(w) for w in last.coefficients), strict=True)), float(last.intercept))


def calibrators(df: DataFrame, label: str = "label", score: str = "score") -> dict[str, DataFrame]:
    """df with its score as it is, after Platt scaling and after isotonic regression."""
    z = VectorAssembler(inputCols=["z"], outputCol="zv").transform(df.withColumn("z", logit(F.col(score))).withColumn("y", F.col(label).cast("double")))
    platt = LogisticRegression(featuresCol="zv", labelCol="y", standardization=False).fit(z)
    a, b = float(platt.coefficients[0]), float(platt.intercept)
    iso = IsotonicRegression(featuresCol="s", labelCol="y").fit(df.withColumn("s", F.col(score)).withColumn("y", F.col(label).cast("double")))
    smooth = iso.transform(df.withColumn("s", F.col(score))).withColumn(score, clip(F.col("prediction"))).drop("s", "prediction")
    return {"identity": df, "platt": df.withColumn(score, 1 / (1 + F.exp(-(F.lit(a) * logit(F.col(score)) + F.lit(b))))), "isotonic": smooth}


def best_calibrator(choices: dict[str, DataFrame], bins: int = 15) -> str:
    """The name with the least (Brier, ECE, name)."""
    rows = []
    for name, df in choices.items():
        r = calibration(df, bins).first()
        rows.append((round(r["brier"], 12), round(r["ece"], 12), name))
    return min(rows)[2]


def hash_fold(key: str, folds: int, seed: int = 3) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int")


def cross_validate(df: DataFrame, features: tuple[str, ...], key: str, names: tuple[str, ...], folds: int = 3) -> DataFrame:
    """name, fold, roc_auc: folds by hash of the key, a model each."""
    df = prepared(df, features).withColumn("fold", hash_fold(key, folds))
    grid, out = candidates(len(features)), None
    for name in names:
        for k in range(folds):
            m = fit(df.where(F.col("fold") != k), features, grid[name])
            part = rank_metrics(scored(m, df.where(F.col("fold") == k))).select(F.lit(name).alias("name"), F.lit(k).alias("fold"), "roc_auc")
            out = part if out is None else out.unionByName(part)
    return out


def choose(results: DataFrame) -> DataFrame:
    """name, mean_auc, std_auc of the best mean; ties to the smaller spread, then the name."""
    s = results.groupBy("name").agg(F.avg("roc_auc").alias("mean_auc"), F.stddev_pop("roc_auc").alias("std_auc"))
    return s.orderBy(F.desc(F.round("mean_auc", 12)), F.round("std_auc", 12), "name").limit(1)


def families_without(families: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """family -> all features but its own."""
    every = [f for fs in families.values() for f in fs]
    return {name: tuple(f for f in every if f not in set(fs)) for name, fs in families.items()}


def ablation(df: DataFrame, families: dict[str, tuple[str, ...]], key: str) -> DataFrame:
    """family, roc_auc of a logistic model without the family's features, on a held-out fold."""
    every = tuple(f for fs in families.values() for f in fs)
    df = prepared(df, every).withColumn("fold", hash_fold(key, 4))
    out = None
    for name, rest in {"none": every, **families_without(families)}.items():
        if rest:
            m = fit(df.where("fold <> 0"), rest, candidates(len(rest))["logistic_1.0"])
            part = rank_metrics(scored(m, df.where("fold = 0"))).select(F.lit(name).alias("family"), "roc_auc")
            out = part if out is None else out.unionByName(part)
    return out


def negative_control(df: DataFrame, features: tuple[str, ...], key: str) -> DataFrame:
    """roc_auc of a model whose labels are dealt by hash: about one half."""
    rate = df.agg(F.avg("label")).first()[0]
    u = F.pmod(F.xxhash64(F.lit(99), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    mixed = prepared(df.withColumn("label", (u < rate).cast("int")), features).withColumn("fold", hash_fold(key, 4))
    m = fit(mixed.where("fold <> 0"), features, candidates(len(features))["logistic_1.0"])
    return rank_metrics(scored(m, mixed.where("fold = 0"))).select("roc_auc")


def role_split(df: DataFrame, key: str, label: str, shares: tuple[tuple[str, float], ...] = (("train", 0.7), ("validation", 0.1), ("calibration", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    """df with role, by 40 bits of a digest of seed, class and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(label).cast("string"), F.lit(":"), F.col(key).cast("string")), 256)
    u = F.conv(F.substring(digest, 1, 10), 16, 10).cast("long") / float(1 << 40)
    bounds, total = [], 0.0
    for name, share in shares[:-1]:
        total += share
        bounds.append((total, name))
    role = F.lit(shares[-1][0])
    for total, name in reversed(bounds):
        role = F.when(u < total, name).otherwise(role)
    return df.withColumn("role", role)
