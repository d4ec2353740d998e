"""Boosted trees: a fit cut off anywhere resumes to the same trees, and their table scores the same in SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from harvestline.constants import FEATURES
from harvestline.plans import boosting, model
from harvestline.plans.steps import StepLog
from harvestline.session import scratch_path

INPUTS = ["a", "b", "c"]
SETTINGS = dict(features=INPUTS, trees=5, depth=3, rate=0.3, bins=16, block=2)


def offers(spark, n=3000):
    """Labels with a step, a slope and some noise; a few null and NaN features, a few null labels."""
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10_000)) / 10_000.0
    rows = spark.range(n, numPartitions=4).select(
        F.col("id"), u(1).alias("a"), F.floor(u(2) * 5).cast("int").alias("b"), u(3).alias("c"),
        (u(3) > 0.8).alias("odd"))
    label = F.when(F.col("a") > 0.6, 0.7).otherwise(0.2) + 0.05 * F.col("b") + 0.02 * u(4)
    return rows.select(
        "id", F.when(F.col("id") % 97 != 5, F.col("a")).alias("a"), "b",
        F.when(F.col("id") % 89 == 3, F.lit(float("nan"))).otherwise(F.col("c")).alias("c"),
        F.when(F.col("id") % 101 != 7, label).alias("label"), "odd")


def nodes(fitted):
    return [tuple(r) for r in fitted.trees.orderBy("tree", "node").collect()]


@pytest.fixture(scope="module")
def fitted(spark):
    return boosting.fit(offers(spark), scratch_path(spark, "boost"), "r", **SETTINGS)


def test_table_gives_the_running_sum_and_the_same_in_duckdb(spark, fitted):
    assert fitted.rows.columns == [*offers(spark).columns, "prediction"]
    scored = boosting.score(fitted.rows, fitted.trees, inputs=INPUTS).toPandas()
    assert len(scored) == 3000
    assert (scored.score == scored.prediction.clip(0, 1)).all()
    # as files, since pandas can't tell null from NaN
    files = {"given": fitted.rows, "trees": fitted.trees}
    with duckdb.connect() as db:
        for name, table in files.items():
            path = scratch_path(spark, name)
            table.write.parquet(path)
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        answer = dict(db.sql(boosting.score_sql("given", "trees", "id", INPUTS)).fetchall())
    assert answer == pytest.approx(dict(zip(scored.id, scored.score, strict=True)), abs=1e-12)


def test_trees_learn(spark):
    rows = offers(spark, 6000)
    unseen = F.col("id") % 5 == 0
    fitted = boosting.fit(rows, scratch_path(spark, "boost"), "r", fitted=~unseen,
                          **{**SETTINGS, "trees": 12, "block": 12, "bins": 64})  # the step at 0.6 lies within a range of 1/16
    scored = boosting.score(rows.where(unseen & F.col("label").isNotNull() & F.col("a").isNotNull()),
                            fitted.trees, inputs=INPUTS)
    assert scored.agg(F.avg(F.abs(F.col("score") - F.col("label")))).first()[0] < 0.02


class Cut(Exception):
    pass


def test_a_cut_fit_resumes_to_the_same_trees(spark, fitted, monkeypatch):
    whole = nodes(fitted)
    folder = scratch_path(spark, "boost")
    cuts: list[str] = []

    class CutLog(StepLog):
        """Ends the run twice at each table: after a torn one without its marker, and after it is done."""

        def again(self, step, built):
            torn = step not in cuts
            if torn:
                self.spark.range(3).write.mode("overwrite").parquet(f"{self.path}/{step}")
            else:
                table = super().again(step, built)
            if cuts.count(step) == 2:
                return table
            cuts.append(step)
            raise Cut

    with monkeypatch.context() as patch:
        patch.setattr(boosting, "StepLog", CutLog)
        for _ in range(50):
            try:
                resumed = boosting.fit(offers(spark), folder, "r", **SETTINGS)
                break
            except Cut:
                continue
    assert nodes(resumed) == whole
    assert set(cuts) == {"plan", "input", "cuts", "base", "rows-0", *(
        f"{table}-{part}" for table in ("trees", "rows") for part in ("1-2", "3-4", "5-5"))}
    # the tables of earlier predictions are gone; a run that is done is only read
    assert nodes(boosting.fit(offers(spark).limit(0), folder, "r", **SETTINGS)) == whole
    with pytest.raises(ValueError, match="other settings"):
        boosting.fit(offers(spark), folder, "r", **{**SETTINGS, "rate": 0.1})


def test_odd_tables(spark):
    rows = offers(spark, 200)
    for none in (rows.limit(0), rows.withColumn("label", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="no labelled row"):
            boosting.fit(none, scratch_path(spark, "boost"), "r", **SETTINGS)
    # nothing to split on: every tree is one leaf
    few = {**SETTINGS, "trees": 2}
    flat = rows.withColumns({"a": F.lit(None).cast("double"), "b": F.lit(1), "c": F.lit(2.0)})
    fitted = boosting.fit(flat, scratch_path(spark, "boost"), "r", **few)
    assert fitted.trees.where("input >= 0").count() == 0
    mean = flat.agg(F.avg("label")).first()[0]
    assert boosting.score(flat, fitted.trees, inputs=INPUTS).first().score == pytest.approx(mean, abs=1e-4)
    assert boosting.score(flat.limit(0), fitted.trees, inputs=INPUTS).count() == 0


def test_versions_of_tree_tables(spark):
    root = scratch_path(spark, "models")
    trees = spark.createDataFrame([(0, 0, 0, -1, None, 0, 0, 0.25)], boosting.NODES)
    for version in (1, 2):
        model.save_trees(trees.withColumn("value", F.lit(version / 4)), root, version)
        model.move_alias(spark, root, "m", "prod", version)
    assert model.load_trees(spark, root, "m").first().value == 0.5
    model.move_alias(spark, root, "m", "prod", 1)
    assert model.load_trees(spark, root, "m").first().value == 0.25


def test_the_pipeline_model_survives_saving(spark):
    row = {name: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).cast("double") for i, name in enumerate(FEATURES)}
    rows = spark.range(300).withColumns(row).withColumn("label", F.col(FEATURES[0]) / 50)
    trained, root = model.fit(rows, trees=2, depth=2, rate=0.3), scratch_path(spark, "models")
    assert 0 < trained.test.count() < 150
    model.save_version(trained.model, root, 1)
    model.move_alias(spark, root, "m", "prod", 1)
    loaded = model.load_alias(spark, root, "m")
    first, second = (model.predict(m, rows).orderBy("id").collect() for m in (trained.model, loaded))
    assert first == second
    assert model.evaluate(loaded, trained.test).first().mae < 0.2


def learnt(node, cuts, out):
    """(feature, end, value) from the root down of a tree of Spark's learner."""
    split = node.split() if node.subtreeDepth() else None
    out.append((-1, None, node.prediction()) if split is None else
               (split.featureIndex(), cuts[split.featureIndex()][int(split.threshold())], node.prediction()))
    if split is not None:
        learnt(node.leftChild(), cuts, out)
        learnt(node.rightChild(), cuts, out)
    return out


def test_trees_are_those_of_sparks_learner_in_a_few_jobs_each(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = offers(spark, 4000).where("label IS NOT NULL")
    folder, trees, depth = scratch_path(spark, "boost"), 3, 4
    spark.sparkContext.setJobGroup("boosting", "fit")
    fitted = boosting.fit(rows, folder, "r", features=INPUTS, trees=trees, depth=depth, rate=0.3, bins=32, block=trees)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting"))
    spark.sparkContext.setJobGroup("others", "others")
    cuts = [list(c) for c in spark.read.parquet(f"{folder}/r/cuts").first().cuts]
    columns = ["x0", "x1", "x2"]
    held = spark.read.parquet(f"{folder}/r/input").withColumn("v", array_to_vector(boosting._ranges(columns, cuts)))
    held = held.withColumn("p", F.lit(spark.read.parquet(f"{folder}/r/base").first().value))
    for number in range(1, trees + 1):
        rest = F.round((F.col("label") - F.col("p")) / boosting.GRAIN) * boosting.GRAIN
        model = DecisionTreeRegressor(featuresCol="v", labelCol="rest", predictionCol="step", maxDepth=depth,
                                      maxBins=32, seed=7).fit(held.withColumn("rest", rest))
        found = fitted.trees.where(F.col("tree") == number).orderBy("node").collect()
        assert [(n.input, n.threshold, n.value) for n in found] == [
            (i, end, 0.3 * value) for i, end, value in learnt(model._call_java("rootNode"), cuts, [])]
        held = model.transform(held).withColumn("p", F.col("p") + 0.3 * F.col("step")).drop("step").localCheckpoint()
    # a job a level, and what the tables of the fit need whatever the number of trees
    assert jobs <= trees * depth + 40


def jobs_of(spark, group, **settings):
    spark.sparkContext.setJobGroup(group, group)
    boosting.fit(offers(spark, 1000), scratch_path(spark, "boost"), "r", **{**SETTINGS, "block": 50, **settings})
    spark.sparkContext.setJobGroup("others", "others")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_block_of_trees_is_one_job(spark):
    assert jobs_of(spark, "many", trees=12) == jobs_of(spark, "few", trees=2)


def test_levels_as_jobs_grow_the_same_trees(spark, fitted, monkeypatch):
    """What runs where executors come and go or the folder is no path."""
    by_jobs = lambda *a: boosting._grow_by_jobs(*a[:6])
    monkeypatch.setattr(boosting, "_grow", by_jobs)
    assert nodes(boosting.fit(offers(spark), scratch_path(spark, "boost"), "r", **SETTINGS)) == nodes(fitted)


def test_scores_of_odd_values_and_deep_trees(spark):
    """Null is below every threshold, NaN above; equal is not above; a chain longer than masks are used for."""
    inf, nan = float("inf"), float("nan")
    small = [(0, 0, 0, -1, None, 0, 0, 0.1), (1, 0, 0, 0, 2.0, 1, 2, 0.0),
             (1, 1, 1, -1, None, 1, 1, 0.2), (1, 2, 1, 1, -1.0, 3, 4, 0.0),
             (1, 3, 2, -1, None, 3, 3, 0.3), (1, 4, 2, -1, None, 4, 4, 0.4)]
    chain = []
    for i in range(40):
        chain += [(2, 2 * i, i, 0, float(i), 2 * i + 1, 2 * i + 2, 0.0), (2, 2 * i + 1, i + 1, -1, None, 2 * i + 1, 2 * i + 1, i / 1000)]
    chain.append((2, 80, 40, -1, None, 80, 80, 0.04))
    rows = [(None, None), (nan, nan), (2.0, 5.0), (2.5, -1.0), (2.5, -0.5), (inf, None), (-inf, 0.0), (17.0, 0.0)]
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double")
    scored = boosting.score(given, spark.createDataFrame(small + chain, boosting.NODES), inputs=["a", "b"])
    assert [r.score for r in scored.orderBy("id").collect()] == pytest.approx(
        [0.3, 0.54, 0.302, 0.403, 0.503, 0.44, 0.3, 0.517])
    none = boosting.score(given, spark.createDataFrame([], boosting.NODES), inputs=["a", "b"])
    assert {r.score for r in none.collect()} == {0.0}
