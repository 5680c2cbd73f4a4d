import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from creditloom.functions.scalars import hash_bucket
from creditloom.operators import metrics, models
from creditloom.operators.splits import share_below
from creditloom.session import cut_off


def rows(spark, n=3000):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    p = 1 / (1 + np.exp(2 - 1.5 * x[:, 0] - x[:, 1] * x[:, 2]))
    return spark.createDataFrame(pd.DataFrame({"loan_seq_num": range(n), "report_date": pd.Timestamp("2001-01-01"), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "default_12m": (rng.random(n) < p).astype(int)}))


def auroc(fitted, df):
    return metrics.discrimination(fitted.transform(df), [], "score", "default_12m").first()["auroc"]


def test_boosting_stops_after_the_best_round(spark):
    df = rows(spark)
    train, test = df.filter("loan_seq_num % 4 <> 0"), df.filter("loan_seq_num % 4 = 0")
    fitted = models.fit_boosted_pd(train, ["a", "b", "c"], [], block=8, patience=4, maxIter=64, maxDepth=3, minInstancesPerNode=5)
    rounds, seen = fitted.trees.n_trees, fitted.aurocs
    assert rounds == models.best_rounds(seen, 4) and len(seen) in (8, 16, 32, 64) and (len(seen) - rounds >= 4 or len(seen) == 64)
    assert seen[rounds - 1] == max(seen[: rounds + 4])
    # the recorded value is the exact AUROC of the validation rows
    held_out = train.filter(share_below(hash_bucket(("loan_seq_num", "report_date"), 11), 0.2))
    assert abs(auroc(fitted, held_out) - seen[rounds - 1]) < 1e-12
    one = models.BoostedPd(fitted.preparation, fitted.trees.first(1))
    assert one.trees.n_trees == 1 and auroc(fitted, test) > auroc(one, test)


def test_patience():
    assert models.best_rounds([1, 2, 3, 2.5, 2.6, 3.5], 2) == 3
    assert models.best_rounds([1, 2, 3, 2.5, 2.6, 3.5], 3) == 6
    assert models.best_rounds([1.0], 20) == 1


def spied(monkeypatch, name):
    """Frames and settings that a Spark estimator of ``models`` is fitted with."""
    seen = []
    plain = getattr(models, name)

    class Spy(plain):
        def _fit(self, dataset):
            seen.append((dataset._jdf.queryExecution().optimizedPlan().toString(), self, dataset.rdd.getNumPartitions()))
            return super()._fit(dataset)

    monkeypatch.setattr(models, name, Spy)
    return seen


def test_rounds_do_not_ship_the_past_of_their_rows(spark, monkeypatch):
    df = rows(spark, 600).repartition(3).withColumn("lgd", F.col("default_12m") * 0.5 + 0.1)
    joined = df.join(df.select("loan_seq_num", F.col("a").alias("d")), "loan_seq_num")
    loss, classes = spied(monkeypatch, "GBTRegressor"), spied(monkeypatch, "GBTClassifier")
    models.fit_loss_models(joined, ["a", "b", "d"], [], forest_params={"numTrees": 2, "maxDepth": 2}, boosted_params={"maxIter": 2, "maxDepth": 2})
    models.fit_boosted_pd(joined, ["a", "b", "d"], [], block=2, maxIter=2, maxDepth=2)
    for plan, _, _ in loss + classes:
        assert "LogicalRDD" in plan and not any(x in plan for x in ("Join", "InMemoryRelation", "Relation [")), plan
    assert not classes[0][1].getCacheNodeIds()


def test_the_rows_of_the_loss_models_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def loss(x):
        made.add(1)
        return min(max(0.5 + 0.1 * x, 0.0), 1.0)

    df = rows(spark, 400).repartition(3).withColumn("kind", F.when(F.col("b") > 0, "x").otherwise("y")).withColumn("lgd", loss("a")).withColumn("d", loss("b"))
    fitted = models.fit_loss_models(df, ["a", "b", "c", "d", "kind"], ["kind"], forest_params={"numTrees": 2, "maxDepth": 2}, boosted_params={"maxIter": 2, "maxDepth": 2})
    assert made.value == 2 * 400
    assert fitted.models["forest"].getNumTrees == 2 and fitted.models["boosted"].getNumTrees == 2


def test_cut_off_keeps_rows_and_partitions(spark):
    df = spark.range(100).repartition(7).withColumn("p", F.spark_partition_id())
    kept = df.persist()
    before = [sorted(p) for p in kept.rdd.glom().collect()]
    assert [sorted(p) for p in cut_off(kept).rdd.glom().collect()] == before


def test_fits_of_short_jobs_get_no_more_tasks_than_rows_are_worth(spark, monkeypatch):
    df = spark.range(1000).repartition(7)
    packed = cut_off(df, packed=True)
    assert packed.rdd.getNumPartitions() == 1 and sorted(r.id for r in packed.collect()) == list(range(1000))
    monkeypatch.setattr("creditloom.session.TASK_ROWS", 300)
    assert cut_off(df, packed=True).rdd.getNumPartitions() == 4
    monkeypatch.setattr("creditloom.session.TASK_ROWS", 1)  # 8 cores: 1000 tasks are too many, 8 would hold more than 32 rows each
    assert cut_off(spark.range(1000).repartition(50), packed=True).rdd.getNumPartitions() == 32
    assert cut_off(df.filter("id < 0"), packed=True).rdd.getNumPartitions() == 1
    learn, loss = rows(spark, 600).repartition(5).withColumn("lgd", F.col("default_12m") * 0.5 + 0.1), spied(monkeypatch, "GBTRegressor")
    monkeypatch.setattr("creditloom.session.TASK_ROWS", 1 << 15)
    models.fit_loss_models(learn, ["a", "b", "c"], [], forest_params={"numTrees": 2, "maxDepth": 2}, boosted_params={"maxIter": 2, "maxDepth": 2})
    assert [parts for _, _, parts in loss] == [1]


def test_rounds_are_measured_from_one_pass(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows(spark, 500)).withColumn("label", F.col("default_12m").cast("double"))
    trees = models.read_trees(GBTClassifier(maxIter=3, maxDepth=2, seed=1).fit(df), spark)
    plans, plain = [], models.metrics.discrimination_of_tally

    def spy(tallied, by, score):
        plans.append(tallied._jdf.queryExecution().optimizedPlan().toString())
        return plain(tallied, by, score)

    monkeypatch.setattr(models.metrics, "discrimination_of_tally", spy)
    assert len(models.staged_auroc(df, trees)) == 3
    assert len(plans) == 1 and "PythonUDF" not in plans[0] and "EvalPython" not in plans[0]
