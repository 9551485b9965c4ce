"""Measured figures: held-out model scores against a baseline.

Models are fitted by Spark's own library on the cluster; folds are hashes of a row id, so that they do not depend on
partitioning.  A status says why a figure is missing: ``not_run``, ``no_lift``, ``withheld`` (too good to be true).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidenta.functions.scalars import close, everything, safe_corr, seeded
from evidenta.operators.attacks import robust_scores
from evidenta.runtime import ship

FOLDS, LEAST_ROWS, LIFT_FLOOR, WITHHOLD = 5, 40, 0.02, 0.995
SEED = 20260817
#: Least agreement of importances between folds, of clusters and components between bootstraps, of anomaly ranks between seeds.
AGREEMENT, CLUSTER_ARI, CLUSTER_SHARE, COMPONENT_MATCH, RANK_MATCH = 0.6, 0.6, 0.03, 0.9, 0.8
BOOTSTRAPS, BUCKET_ROWS = 5, 100_000

MENU = {
    "ridge": lambda label: LinearRegression(labelCol=label, regParam=0.1, elasticNetParam=0.0),
    "forest": lambda label: RandomForestRegressor(labelCol=label, numTrees=40, maxDepth=4, seed=SEED),
    "boosting": lambda label: GBTRegressor(labelCol=label, maxIter=40, maxDepth=2, stepSize=0.1, seed=SEED),
}
CLASSIFIERS = {
    "logistic": lambda label: LogisticRegression(labelCol=label, regParam=0.01),
    "forest": lambda label: RandomForestClassifier(labelCol=label, numTrees=40, maxDepth=4, seed=SEED),
    "boosting": lambda label: GBTClassifier(labelCol=label, maxIter=20, maxDepth=2, stepSize=0.1, seed=SEED),
}


def fold_of(row_id: Column, folds: int = FOLDS, seed: int = SEED) -> Column:
    """A row's fold: hash of its id (or of its entity, to keep entities whole)."""
    return F.pmod(F.conv(F.substring(seeded(seed, row_id), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def time_folds(df: DataFrame, ordinal: str, folds: int = FOLDS) -> DataFrame:
    """Folds of consecutive periods; a fold is tested on models of earlier ones only."""
    periods = df.select(F.col(ordinal).alias("p")).distinct().withColumn("rn", F.row_number().over(Window.orderBy("p")) - 1).withColumn("k", F.count(F.lit(1)).over(everything()))
    placed = periods.select(F.col("p").alias("fold_period"), F.floor(F.col("rn") * (folds + 1) / F.col("k")).cast("int").alias("fold"))
    return df.join(F.broadcast(placed), F.col(ordinal) == F.col("fold_period")).drop("fold_period")


def preprocessor(numeric: list[str], labels: list[str]) -> list:
    """Median and most-frequent imputation, scaling, one-hot levels with room for unseen ones."""
    stages: list = [Imputer(inputCols=numeric, outputCols=[f"i_{c}" for c in numeric], strategy="median")] if numeric else []
    for c in labels:
        stages += [StringIndexer(inputCol=c, outputCol=f"x_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"x_{c}", outputCol=f"h_{c}", handleInvalid="keep")]
    if numeric:
        stages += [VectorAssembler(inputCols=[f"i_{c}" for c in numeric], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
    return [*stages, VectorAssembler(inputCols=(["scaled"] if numeric else []) + [f"h_{c}" for c in labels], outputCol="features")]


def _status(score: float, lift: float) -> str:
    return "withheld" if score >= WITHHOLD else "no_lift" if lift < LIFT_FLOOR else "ok"


def driver_regression(df: DataFrame, target: str, numeric: list[str], labels: list[str], row_id: str, folds: int = FOLDS) -> DataFrame:
    """(model, r2, spread, lift, status) over outer folds; the baseline is the training mean."""
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), *numeric, *labels, fold_of(F.col(row_id), folds).alias("fold")).persist()
    if rows.count() < LEAST_ROWS:
        return df.sparkSession.createDataFrame([("none", None, None, None, "not_run")], "model string, r2 double, spread double, lift double, status string")
    scores: dict[str, list[float]] = {m: [] for m in MENU}
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        prepared = Pipeline(stages=preprocessor(numeric, labels)).fit(train)
        fit_on, held = prepared.transform(train).select("y", "features").persist(), prepared.transform(test).select("y", "features").persist()
        for name, make in MENU.items():
            predicted = make("y").fit(fit_on).transform(held)
            scores[name].append(RegressionEvaluator(labelCol="y", metricName="r2").evaluate(predicted))
        fit_on.unpersist(), held.unpersist()
    out = [(m, float(np.mean(s)), float(np.std(s)), float(np.mean(s)), _status(float(np.mean(s)), float(np.mean(s)))) for m, s in scores.items()]
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "model string, r2 double, spread double, lift double, status string")


def class_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """``rows`` with ``weight``: every class weighs the same in all; one row per class is joined."""
    sizes = rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("m"))
    shares = sizes.select("class", (F.sum("m").over(everything()) / (F.count(F.lit(1)).over(everything()) * F.col("m"))).alias("weight"))
    return rows.join(F.broadcast(shares), F.col(label) == F.col("class")).drop("class")


def balanced_accuracy(predicted: DataFrame, label: str = "y") -> float:
    """Mean over the classes of the share of their rows that are predicted right."""
    recall = predicted.groupBy(label).agg(F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("recall"))
    return float(recall.agg(F.avg("recall")).first()[0] or 0.0)


def driver_classification(df: DataFrame, target: str, numeric: list[str], labels: list[str], row_id: str, folds: int = FOLDS) -> DataFrame:
    """(model, balanced_accuracy, baseline, lift, status) over outer folds; models weigh classes alike.

    The baseline predicts the majority class, so it is right about one class of those that a fold holds.
    """
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("label"), *numeric, *labels, fold_of(F.col(row_id), folds).alias("fold")).persist()
    indexed = StringIndexer(inputCol="label", outputCol="y").fit(rows).transform(rows).persist()
    classes = indexed.agg(F.count_distinct("y")).first()[0]
    scores: dict[str, list[float]] = {m: [] for m in CLASSIFIERS if classes == 2 or m != "boosting"}
    base: list[float] = []
    for k in range(folds):
        train, test = class_weights(indexed.where(F.col("fold") != k)), indexed.where(F.col("fold") == k)
        prepared = Pipeline(stages=preprocessor(numeric, labels)).fit(train)
        fit_on, held = prepared.transform(train).select("y", "weight", "features").persist(), prepared.transform(test).select("y", "features").persist()
        top = train.groupBy("y").count().orderBy(F.col("count").desc(), "y").first()["y"]
        base.append(balanced_accuracy(held.withColumn("prediction", F.lit(top))))
        for name in scores:
            scores[name].append(balanced_accuracy(CLASSIFIERS[name]("y").setWeightCol("weight").fit(fit_on).transform(held)))
        fit_on.unpersist(), held.unpersist()
    floor = float(np.mean(base))
    out = [(m, float(np.mean(s)), floor, float(np.mean(s)) - floor, _status(float(np.mean(s)), float(np.mean(s)) - floor)) for m, s in scores.items()]
    rows.unpersist(), indexed.unpersist()
    return df.sparkSession.createDataFrame(out, "model string, balanced_accuracy double, baseline double, lift double, status string")


def nearest_neighbours(train: DataFrame, test: DataFrame, features: list[str], target: str, row_id: str, k: int = 5, cells: int = 16) -> DataFrame:
    """kNN regression inside hash-free grid cells of the first feature: neighbours come from the row's and adjacent cells.

    Cell edges are quantiles, so cells hold even shares; each training row is copied to three cells, so work is bounded
    by cell size and not by the product of the tables.
    """
    edges = train.agg(F.percentile_approx(features[0], F.lit([i / cells for i in range(1, cells)]), 1000)).first()[0]
    cell = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(features[0])))
    near = train.select(F.struct(*features).alias("p"), F.col(target).alias("t"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    asked = test.select(row_id, F.struct(*features).alias("q"), cell.alias("cell"))
    distance = sum(((F.col(f"p.{f}") - F.col(f"q.{f}")) * (F.col(f"p.{f}") - F.col(f"q.{f}")) for f in features), F.lit(0.0))
    ranked = asked.join(near, "cell").withColumn("d", distance).withColumn("rn", F.row_number().over(Window.partitionBy(row_id).orderBy("d", "t")))
    return ranked.where(F.col("rn") <= k).groupBy(row_id).agg(F.avg("t").alias("prediction"))


def permutation_importance(model, held: DataFrame, features: list[list[str]], prepare: Callable[[DataFrame], DataFrame], row_id: str, seed: int = SEED) -> list[tuple[str, float]]:
    """Loss of R2 when a group of features is shuffled: rows take the values of the next row in hash order, bucket by bucket.

    Buckets are ranges of the hash, so that a window holds about BUCKET_ROWS rows and rows move at random inside them.
    """
    metric = RegressionEvaluator(labelCol="y", metricName="r2")
    base = metric.evaluate(model.transform(prepare(held)))
    buckets = max(1, held.count() // BUCKET_ROWS)
    draw = seeded(seed, F.col(row_id))
    dealt = held.withColumn("draw", draw).withColumn("bucket", F.pmod(F.xxhash64("draw"), F.lit(buckets)))
    by = Window.partitionBy("bucket").orderBy("draw", row_id)
    whole_bucket = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = []
    for group in features:
        moved = dealt.withColumns({c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole_bucket)) for c in group}).drop("draw", "bucket")
        out.append(("+".join(group), base - metric.evaluate(model.transform(prepare(moved)))))
    return out


def driver_importance(df: DataFrame, target: str, numeric: list[str], labels: list[str], row_id: str, folds: int = FOLDS) -> DataFrame:
    """(feature, importance, low, high, agreement, status): loss of held-out R2 of the forest, over the outer folds.

    ``agreement`` is the mean rank correlation of the importances between folds; below AGREEMENT no order is claimed.
    """
    rows = df.where(F.col(target).isNotNull()).select(F.col(row_id).alias("rid"), F.col(target).cast("double").alias("y"), *numeric, *labels, fold_of(F.col(row_id), folds).alias("fold")).persist()
    names, losses = [*numeric, *labels], []
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        prepared = Pipeline(stages=preprocessor(numeric, labels)).fit(train)
        model = MENU["forest"]("y").fit(prepared.transform(train))
        losses.append([v for _, v in permutation_importance(model, test, [[n] for n in names], prepared.transform, "rid")])
    rows.unpersist()
    found = np.array(losses)
    orders = found.argsort(axis=1).argsort(axis=1).astype(float)
    pairs = [np.corrcoef(orders[i], orders[j])[0, 1] for i in range(folds) for j in range(i + 1, folds)] if len(names) > 1 else [1.0]
    agreement = float(np.mean(pairs))
    status = "ok" if agreement >= AGREEMENT else "unstable"
    out = [(n, float(found[:, i].mean()), float(found[:, i].min()), float(found[:, i].max()), agreement, status) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(out, "feature string, importance double, low double, high double, agreement double, status string")


def leakage_lint(df: DataFrame, target: str, numeric: list[str], tolerance: float = 1e-3, share: float = 0.99) -> DataFrame:
    """(feature, kind, value): features that give the target away.

    An exact line, an identity with a second column (sum or difference), or a near-unique id; two aggregations in all.
    Distinct values are only counted of columns that hold whole numbers.
    """
    y = F.col(target).cast("double")
    lines = df.agg(*[F.regr_slope(y, F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(numeric)], *[F.regr_intercept(y, F.col(c).cast("double")).alias(f"t{i}") for i, c in enumerate(numeric)],
                   *[F.min((F.col(c).cast("double") % 1 == 0).cast("int")).alias(f"w{i}") for i, c in enumerate(numeric)]).first()
    cells = []
    for i, c in enumerate(numeric):
        x = F.col(c).cast("double")
        if lines[f"s{i}"] is not None:
            cells.append((c, "line", F.avg(close(F.lit(lines[f"s{i}"]) * x + F.lit(lines[f"t{i}"]), y, tolerance).cast("int"))))
        if lines[f"w{i}"] == 1:
            cells.append((c, "unique_id", F.try_divide(F.count_distinct(x), F.count(x))))
        for o in numeric:
            if o == c:
                continue
            z = F.col(o).cast("double")
            cells.append((f"{c} - {o}", "identity", F.avg(close(x - z, y, tolerance).cast("int"))))
            if c < o:
                cells.append((f"{c} + {o}", "identity", F.avg(close(x + z, y, tolerance).cast("int"))))
    row = df.agg(*[e.alias(f"v{i}") for i, (_, _, e) in enumerate(cells)])
    flat = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(k).alias("kind"), F.col(f"v{i}").cast("double").alias("value")) for i, (n, k, _) in enumerate(cells)])).alias("x")).select("x.*")
    return flat.where(F.when(F.col("kind") == "unique_id", F.col("value") >= 0.98).otherwise(F.col("value") >= share))


def proxies(df: DataFrame, target: str, numeric: list[str], row_id: str, least: float = 0.95) -> DataFrame:
    """(feature, r2, proxy): held-out R2 of a shallow tree on one feature alone."""
    rows = df.select(F.col(target).cast("double").alias("y"), *numeric, fold_of(F.col(row_id), 3).alias("fold")).dropna().persist()
    out = []
    for c in numeric:
        flat = VectorAssembler(inputCols=[c], outputCol="features").transform(rows)
        model = DecisionTreeRegressor(labelCol="y", maxDepth=6).fit(flat.where("fold > 0"))
        r2 = RegressionEvaluator(labelCol="y", metricName="r2").evaluate(model.transform(flat.where("fold = 0")))
        out.append((c, r2, r2 >= least))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "feature string, r2 double, proxy boolean")


def adjusted_association(df: DataFrame, x: str, y: str, controls: list[str], row_id: str, folds: int = FOLDS) -> DataFrame:
    """One row: held-out lift of adding x to a linear model with the controls, and how often its sign agrees."""
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), *[F.col(c).cast("double").alias(c) for c in controls], fold_of(F.col(row_id), folds).alias("fold")).dropna().persist()
    binary = rows.select("y").distinct().limit(3).count() == 2
    lifts, signs = [], []
    for k in range(folds):
        scores = []
        for columns in (controls, [*controls, "x"]):
            flat = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
            train, test = flat.where(F.col("fold") != k), flat.where(F.col("fold") == k)
            if binary:
                model = LogisticRegression(labelCol="y").fit(train)
                scores.append(BinaryClassificationEvaluator(labelCol="y").evaluate(model.transform(test)))
            else:
                model = LinearRegression(labelCol="y", regParam=1e-6).fit(train)
                scores.append(RegressionEvaluator(labelCol="y", metricName="r2").evaluate(model.transform(test)))
        signs.append(float(np.sign(model.coefficients[len(controls)])))
        lifts.append(scores[1] - scores[0])
    rows.unpersist()
    agreement = max(signs.count(1.0), signs.count(-1.0)) / len(signs)
    out = [("auc" if binary else "r2", float(np.mean(lifts)), agreement, "ok" if np.mean(lifts) >= LIFT_FLOOR else "no_lift")]
    return df.sparkSession.createDataFrame(out, "metric string, lift double, sign_agreement double, status string")


def segments(df: DataFrame, features: list[str], row_id: str, most: int = 6, nulls: int = 5, margin: float = 0.05) -> DataFrame:
    """(k, train, held_out, null, bootstrap_ari, least_share, status): squared-Euclidean silhouettes of k-means.

    The chosen k is compared with shuffled columns, with models of bootstrapped rows (the mean adjusted Rand index of
    their labels of all rows has to be CLUSTER_ARI) and by its smallest cluster (CLUSTER_SHARE of the rows).  The
    metric is Spark's squared-Euclidean silhouette, not the Euclidean one.
    """
    rows = df.select(F.col(row_id).alias("rid"), *[F.col(c).cast("double").alias(c) for c in features]).dropna().withColumn("train", fold_of(F.col("rid"), 10) < 7)
    scaled = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)])
    flat = scaled.fit(rows).transform(rows).select("rid", "train", "features").persist()
    metric = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean")
    found, models = [], {}
    for k in range(2, most + 1):
        model = models[k] = KMeans(k=k, seed=SEED, maxIter=50).fit(flat.where("train"))
        found.append((k, metric.evaluate(model.transform(flat.where("train"))), metric.evaluate(model.transform(flat.where("not train")))))
    best = max(found, key=lambda r: r[1])
    worst_null = max(_null_silhouette(rows, features, best[0], i, scaled, metric) for i in range(nulls))
    told = models[best[0]].transform(flat).select("rid", "features", F.col("prediction").alias("own")).persist()
    sizes = [r["count"] for r in told.groupBy("own").count().collect()]  # one row per cluster
    share = min(sizes) / sum(sizes)
    agreed = []
    for b in range(BOOTSTRAPS):
        again = KMeans(k=best[0], seed=SEED, maxIter=50).fit(flat.where("train").sample(True, 1.0, SEED + b).select("features"))
        agreed.append(adjusted_rand(again.transform(told), "own", "prediction").first()["ari"])
    ari = float(np.mean(agreed))
    flat.unpersist(), told.unpersist()
    status = "no_lift" if best[2] < worst_null + margin else "unstable" if ari < CLUSTER_ARI else "too_small" if share < CLUSTER_SHARE else "ok"
    chosen = lambda k, v: v if k == best[0] else None
    out = [(k, t, h, chosen(k, float(worst_null)), chosen(k, ari), chosen(k, share), status if k == best[0] else "not_chosen") for k, t, h in found]
    return df.sparkSession.createDataFrame(out, "k int, train double, held_out double, null double, bootstrap_ari double, least_share double, status string")


def _null_silhouette(rows: DataFrame, features: list[str], k: int, seed: int, scaled: Pipeline, metric: ClusteringEvaluator) -> float:
    """The same on columns that are shuffled against each other."""
    base = rows.select("rid", "train", features[0]).withColumn("i", F.row_number().over(Window.orderBy("rid")))
    out = base
    for c in features[1:]:
        moved = rows.select(c, F.row_number().over(Window.orderBy(seeded(f"{seed}:{c}", F.col("rid")), "rid")).alias("i"))
        out = out.join(moved, "i")
    flat = scaled.fit(out).transform(out).select("train", "features").persist()
    model = KMeans(k=k, seed=SEED, maxIter=50).fit(flat.where("train"))
    value = metric.evaluate(model.transform(flat.where("not train")))
    flat.unpersist()
    return value


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from contingency counts."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(pairs("n").alias("both"), F.sum("n").alias("total")).withColumn("one", F.lit(0))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("left")).withColumn("one", F.lit(0))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("right")).withColumn("one", F.lit(0))
    row = both.join(F.broadcast(left), "one").join(F.broadcast(right), "one")
    expected = F.try_divide(F.col("left") * F.col("right"), F.col("total") * (F.col("total") - 1) / 2)
    return row.select("total", F.coalesce(F.try_divide(F.col("both") - expected, (F.col("left") + F.col("right")) / 2 - expected), F.lit(1.0)).alias("ari"))


def isolation_trees(sample: np.ndarray, trees: int, seed: int) -> list:
    """Trees of random cuts over subsamples of at most 256 rows."""
    rng = np.random.default_rng(seed)

    def grow(x: np.ndarray, depth: int):
        if depth == 8 or len(x) <= 1:
            return len(x)
        c = int(rng.integers(x.shape[1]))
        low, high = x[:, c].min(), x[:, c].max()
        if low == high:
            return len(x)
        cut = rng.uniform(low, high)
        left = x[:, c] < cut
        return (c, cut, grow(x[left], depth + 1), grow(x[~left], depth + 1))

    return [grow(sample[rng.choice(len(sample), min(256, len(sample)), replace=False)], 0) for _ in range(trees)]


def path_lengths(x: np.ndarray, tree, depth: int = 0) -> np.ndarray:
    if isinstance(tree, int):
        n = max(tree, 1)
        extra = 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0
        return np.full(len(x), depth + extra)
    c, cut, left, right = tree
    out = np.empty(len(x))
    under = x[:, c] < cut
    out[under] = path_lengths(x[under], left, depth + 1)
    out[~under] = path_lengths(x[~under], right, depth + 1)
    return out


def rank_agreement(scores: np.ndarray) -> float:
    """The least rank correlation between the rows of (seeds, rows) scores."""
    order = pd.DataFrame(scores.T).rank().to_numpy().T
    found = [np.corrcoef(order[i], order[j])[0, 1] for i in range(len(order)) for j in range(i + 1, len(order))]
    return float(np.nan_to_num(min(found, default=1.0)))


def anomalies(df: DataFrame, features: list[str], row_id: str, share: float = 0.02, seeds: int = 5, trees: int = 60, sample_rows: int = 5000) -> DataFrame:
    """(row id, score, flagged, shifted, status): mean path length over seeds of isolation trees, the shortest share flagged.

    Trees are grown on the driver from a bounded hash sample and sent to the tasks that score the rows once; ``shifted``
    marks flagged rows that are also robust outliers of a single column.  Where the seeds rank the sample's rows too
    differently (RANK_MATCH) the status is ``unstable``.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(row_id).alias("rid"), *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    sample = rows.orderBy(seeded(SEED, F.col("rid"))).limit(sample_rows).select(*features).toPandas().to_numpy()
    forests = [isolation_trees(sample, trees, s) for s in range(seeds)]
    of_seed = lambda f, x: np.mean([path_lengths(x, t) for t in f], axis=0)
    status = "ok" if len(sample) < 2 or rank_agreement(np.array([of_seed(f, sample) for f in forests])) >= RANK_MATCH else "unstable"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part[features].to_numpy()
            score = np.mean([of_seed(f, x) for f in forests], axis=0) if len(x) else np.empty(0)
            yield pd.DataFrame({"rid": part["rid"], "score": np.round(score, 6)})

    scored = rows.mapInPandas(run, f"rid {dict(rows.dtypes)['rid']}, score double").persist()
    cut = scored.agg(F.percentile_approx("score", share, 100_000).alias("cut")).first()["cut"]
    extreme = robust_scores(rows, features).select(F.col("rid").alias("r2"), (F.col("extremity") >= 3.5).alias("shifted"))
    flagged = scored.where(F.col("score") <= F.lit(cut))
    return flagged.join(extreme, F.col("rid") == F.col("r2")).select(F.col("rid").alias("row_id"), "score", "shifted", F.lit(status).alias("status"))


def poisson_weight(draw: Column, most: int = 8) -> Column:
    """A Poisson(1) draw from the first eight hexadecimal digits of a hash: how often a bootstrap takes a row."""
    u = F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / float(2**32)
    below, term, out = 0.0, float(np.exp(-1.0)), F.lit(0)
    for k in range(most):
        below += term
        out = out + (u >= below).cast("int")
        term /= k + 1
    return out


def correlation_matrices(df: DataFrame, features: list[str], row_id: str | None, bootstraps: int, seed: int) -> tuple[int, list[np.ndarray]]:
    """(rows, correlation matrices): of all rows, then of Poisson bootstraps, from one aggregation of weighted sums."""
    p = len(features)
    rows = df.dropna(subset=features).select(*([F.col(row_id).alias("rid")] if row_id else []), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    centre = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]).first()
    x = [F.col(f"x{i}") - F.lit(centre[f"m{i}"] or 0.0) for i in range(p)]
    weights = [F.lit(1.0)] + [poisson_weight(seeded(f"{seed}:{b}", F.col("rid"))) for b in range(bootstraps if row_id else 0)]
    sums = []
    for b, w in enumerate(weights):
        sums += [F.sum(w).cast("double").alias(f"n_{b}")] + [F.sum(w * x[i]).alias(f"s_{b}_{i}") for i in range(p)]
        sums += [F.sum(w * x[i] * x[j]).alias(f"q_{b}_{i}_{j}") for i in range(p) for j in range(i, p)]
    row = rows.agg(*sums).first()
    out = []
    for b in range(len(weights)):
        n = row[f"n_{b}"] or 1.0
        mean = np.array([row[f"s_{b}_{i}"] or 0.0 for i in range(p)]) / n
        cov = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = (row[f"q_{b}_{i}_{j}"] or 0.0) / n - mean[i] * mean[j]
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        matrix = cov / np.outer(sd, sd)
        matrix[sd <= 1e-150, :] = matrix[:, sd <= 1e-150] = 0.0
        np.fill_diagonal(matrix, 1.0)
        out.append(matrix)
    return int(centre["n"]), out


def components(df: DataFrame, features: list[str], nulls: int = 20, quantile: float = 0.95, seed: int = SEED, row_id: str | None = None, bootstraps: int = BOOTSTRAPS) -> DataFrame:
    """(component, eigenvalue, null, stability, kept): eigenvalues of the correlation matrix against a null.

    An approximation to parallel analysis: shuffled columns of n rows have correlations of spread 1 / sqrt(n - 1), and
    null matrices are drawn from it instead of shuffling n rows.  With a row id a component also has to return in
    bootstraps (``stability``: mean absolute cosine with the bootstrap's component, at least COMPONENT_MATCH).
    """
    p = len(features)
    n, matrices = correlation_matrices(df, features, row_id, bootstraps, seed)
    values, vectors = np.linalg.eigh(matrices[0])
    values, vectors = values[::-1], vectors[:, ::-1]
    rng = np.random.default_rng(seed)
    drawn = []
    for _ in range(nulls):
        m = np.eye(p)
        m[np.triu_indices(p, 1)] = rng.normal(0, 1 / np.sqrt(max(n - 1, 1)), p * (p - 1) // 2)
        drawn.append(np.sort(np.linalg.eigvalsh(np.triu(m) + np.triu(m, 1).T))[::-1])
    limit = np.quantile(drawn, quantile, axis=0)
    again = [np.linalg.eigh(m)[1][:, ::-1] for m in matrices[1:]]
    match = [float(np.mean([abs(vectors[:, i] @ v[:, i]) for v in again])) if again else None for i in range(p)]
    run = np.cumprod([values[i] > limit[i] and (match[i] is None or match[i] >= COMPONENT_MATCH) for i in range(p)]).astype(bool)
    out = [(i + 1, float(values[i]), float(limit[i]), match[i], bool(run[i])) for i in range(p)]
    return df.sparkSession.createDataFrame(out, "component int, eigenvalue double, null double, stability double, kept boolean")


def threshold_sums(df: DataFrame, x: str, y: str, grid: int = 15, edge: float = 0.15) -> DataFrame:
    """(position, bend, sse): squared error of a line with one bend at each of ``grid`` quantiles of x.

    Each bend's normal equations are sums, all taken in one aggregation; only 3 x 3 systems are solved outside.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    qs = [edge + (1 - 2 * edge) * i / (grid - 1) for i in range(grid)]
    facts = rows.agg(F.percentile("x", F.lit(qs)).alias("q"), F.avg("x").alias("mx"), F.avg("y").alias("my")).first()
    if facts["q"] is None:
        return df.sparkSession.createDataFrame([], "position int, bend double, sse double")
    a, v = F.col("x") - F.lit(facts["mx"]), F.col("y") - F.lit(facts["my"])
    sums = [F.count(F.lit(1)).alias("n"), F.sum(a * a).alias("xx"), F.sum(a * v).alias("xy"), F.sum(v * v).alias("yy"), F.sum(a).alias("sx"), F.sum(v).alias("sy")]
    for i, q in enumerate(facts["q"]):
        h = F.greatest(F.col("x") - F.lit(q), F.lit(0.0))
        sums += [F.sum(h).alias(f"h{i}"), F.sum(h * h).alias(f"hh{i}"), F.sum(h * a).alias(f"hx{i}"), F.sum(h * v).alias(f"hy{i}")]
    r = rows.agg(*sums).first()
    out = []
    for i, q in enumerate(facts["q"]):
        m = np.array([[r["n"], r["sx"], r[f"h{i}"]], [r["sx"], r["xx"], r[f"hx{i}"]], [r[f"h{i}"], r[f"hx{i}"], r[f"hh{i}"]]])
        b = np.array([r["sy"], r["xy"], r[f"hy{i}"]])
        beta, *_ = np.linalg.lstsq(m, b, rcond=None)
        out.append((i, float(q), float(r["yy"] - beta @ b)))
    return df.sparkSession.createDataFrame(out, "position int, bend double, sse double")


def threshold_fit(df: DataFrame, x: str, y: str, row_id: str) -> DataFrame:
    """One row: the best bend on training rows, and its held-out R2 against a straight line's."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (fold_of(F.col(row_id), 10) < 7).alias("train")).dropna().persist()
    sums = threshold_sums(rows.where("train"), "x", "y").orderBy("sse", "position").first()
    if sums is None:
        rows.unpersist()
        return df.sparkSession.createDataFrame([(None, None, None, "not_run")], "bend double, r2 double, lift double, status string")
    bent = rows.withColumn("h", F.greatest(F.col("x") - F.lit(sums["bend"]), F.lit(0.0)))
    scores = []
    for columns in (["x"], ["x", "h"]):
        flat = VectorAssembler(inputCols=columns, outputCol="features").transform(bent)
        model = LinearRegression(labelCol="y", regParam=0.0).fit(flat.where("train"))
        scores.append(RegressionEvaluator(labelCol="y", metricName="r2").evaluate(model.transform(flat.where("not train"))))
    rows.unpersist()
    lift = scores[1] - scores[0]
    return df.sparkSession.createDataFrame([(sums["bend"], scores[1], lift, "ok" if lift >= LIFT_FLOOR else "no_lift")], "bend double, r2 double, lift double, status string")
