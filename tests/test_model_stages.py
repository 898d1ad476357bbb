"""The interval model's gradient and fit, and stages that a rerun finds again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import model as ML
from kinweave.plans import classify
from kinweave.sources import staging


def chances(x, weights, cuts, fixed):
    q = [f if f is not None else 1 / (1 + np.exp(-(x @ w - c))) for f, w, c in zip(fixed, weights, cuts, strict=True)]
    reach = np.append(np.cumprod([1.0, *q]), 0.0)
    return reach[:-1] - reach[1:]


@pytest.mark.parametrize("fixed", [[None] * 3, [1.0, None, 0.0]])
def test_loss_and_gradient_are_those_of_the_intervals(fixed):
    rng = np.random.default_rng(2)
    x, weights, cuts = rng.normal(size=(40, 5)), rng.normal(size=(3, 5)), rng.normal(size=3)
    first, last = (0, 3) if fixed[0] is None else (1, 2)
    lower = rng.integers(first, last + 1, 40)
    upper = np.minimum(last, lower + rng.integers(0, 4, 40))

    def loss(w, c):
        return -sum(np.log(chances(r, w, c, fixed)[a:b + 1].sum()) for r, a, b in zip(x, lower, upper, strict=True))

    sums = ML.interval_sums(x, lower, upper, weights, cuts, fixed)
    assert sums[0] == pytest.approx(loss(weights, cuts))
    for k in range(3):
        if fixed[k] is None:
            for j in range(6):
                w, c = (np.stack([weights] * 2), np.stack([cuts] * 2))
                for n, sign in enumerate((1, -1)):
                    (w[n][k] if j < 5 else c[n])[j if j < 5 else k] += sign * 1e-6
                slope = (loss(w[0], c[0]) - loss(w[1], c[1])) / 2e-6
                assert sums[1 + 5 * k + j if j < 5 else 16 + k] == pytest.approx(slope, abs=1e-4)


def test_intervals_that_decide_nothing_or_too_much(spark):
    schema = "features array<double>, lower int, upper int"
    wide = spark.createDataFrame([([1.0], 0, 2), ([2.0], 0, 2)], schema)
    assert ML.ordinal_interval_fit(wide, 3).transform(wide).first().probs == [1.0, 0.0, 0.0]
    empty = spark.createDataFrame([], schema)
    assert ML.ordinal_interval_fit(empty, 3).thresholds == [0.0, 0.0]


def test_fits_made_together_are_those_made_alone(spark):
    rng = np.random.default_rng(5)
    rows = [(x.tolist(), int(k), int(min(2, k + rng.integers(0, 2)))) for x in rng.normal(size=(200, 4)) for k in [np.digitize(x[0] + 0.3 * rng.normal(), [-0.5, 0.5])]]
    df = spark.createDataFrame(rows, "features array<double>, lower int, upper int").repartition(3)
    both = ML.interval_fits(df, 3, [0.01, 1.0])
    for reg, made in zip((0.01, 1.0), both, strict=True):
        assert np.allclose(made.weights, ML.ordinal_interval_fit(df, 3, reg).weights)
    assert np.abs(both[1].weights).sum() < np.abs(both[0].weights).sum()
    pred = both[0].transform(df).withColumn("pred", F.expr("array_position(probs, array_max(probs)) - 1"))
    assert pred.where("pred between lower and upper").count() > 160


def test_finished_stages_are_not_built_again(spark):
    folder, built = staging.scratch_path(spark, "test"), []

    def build(name, fails=False):
        def run():
            built.append(name)
            staging.materialize(spark.range(5), "inner").count()
            if fails:
                raise RuntimeError("lost")
            return spark.range(3)
        return run

    def scratch():
        fs, at = staging._hadoop_path(spark, staging.shared_dir(spark))
        return {s.getPath().getName() for s in fs.listStatus(at) if "-inner-" in s.getPath().getName()}

    before = scratch()
    stages = staging.Stages(spark, folder, "k")
    stages.table("a", build("a"))
    with pytest.raises(RuntimeError):
        stages.result("end", build("end", fails=True))
    again = staging.Stages(spark, folder, "k")  # a rerun after the failure
    again.table("a", build("a"))
    assert again.result("end", build("end")).count() == 3 and built == ["a", "end", "end"]
    assert not staging.stage_exists(spark, f"{folder}/k/a") and scratch() == before
    assert staging.Stages(spark, folder, "k").result("end", build("end")).count() == 3 and len(built) == 3


def test_contents_and_settings_name_a_run(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    key = staging.content_key([rows], 5)
    assert key == staging.content_key([rows.repartition(3)], 5)
    assert len({key, staging.content_key([rows], 6), staging.content_key([rows.distinct()], 5), staging.content_key([rows.where("i = 1")], 5), staging.content_key([], 5)}) == 5


def test_a_second_classification_redoes_nothing(spark, monkeypatch):
    folder, runs = staging.scratch_path(spark, "runs"), []
    monkeypatch.setattr(classify, "_classified", lambda *a: runs.append(1) or spark.range(4))
    tables = [spark.createDataFrame([("x", "y")], "query string, target string") for _ in range(4)]
    assert [classify.classify_queries(*tables, classify.WorkflowParams(), folder).count() for _ in range(2)] == [4, 4] and len(runs) == 1
    classify.classify_queries(*tables, classify.WorkflowParams(epochs=1), folder)
    classify.classify_queries(*tables, classify.WorkflowParams())
    classify.classify_queries(*tables, classify.WorkflowParams())
    assert len(runs) == 4


def test_nth_rows_are_those_of_the_ordinals(spark):
    from kinweave.operators.skew import nth_rows, with_ordinal

    rows = spark.range(3000).select((F.col("id") % 7).alias("g"), F.concat(F.lit("k"), "id").alias("key")).where("g < 3 or key < 'k2'")
    numbered = with_ordinal(rows, ["key"], ["g"], "s")
    wanted = numbered.where("ordinal % 11 = 0 or ordinal < 2").select("g", "ordinal", F.lit(1).alias("more"))
    wanted = wanted.union(wanted.limit(5))  # the same place may be asked for twice
    for digits in (1, 3):
        got = sorted(tuple(r) for r in nth_rows(rows, ["key"], ["g"], wanted, "s", digits).select("g", "ordinal", "more", "key").collect())
        assert got == sorted(tuple(r) for r in wanted.join(numbered, ["g", "ordinal"]).select("g", "ordinal", "more", "key").collect())
    assert nth_rows(rows.limit(0), ["key"], ["g"], wanted, "s").count() == 0
