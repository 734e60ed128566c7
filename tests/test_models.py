"""Model tests: LR equals the C=1 weighted optimum, probabilities are valid,
weights sum to 100, seeds repeat, the scored export has the fixed contract."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelens.config import Config
from carelens.plans import inputs as I
from carelens.plans import train as TR
from carelens.plans.scoring import BATCH_EXPORT
from carelens.session import jit_sized_methods

from conftest import SF0001


@pytest.fixture(scope="module")
def fitted(spark):
    return TR.fit(spark, I.prepared(spark, SF0001), Config("batch"))


def _newton_lr(x, y, w, c=1.0, iters=100):
    xa = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(xa.shape[1])
    reg = np.eye(xa.shape[1]) / c
    reg[-1, -1] = 0.0  # intercept not penalised
    for _ in range(iters):
        p = 1 / (1 + np.exp(-xa @ beta))
        grad = xa.T @ (w * (p - y)) + reg @ beta
        hess = (xa * (w * p * (1 - p))[:, None]).T @ xa + reg
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def test_lr_equals_c1_optimum(fitted):
    feats = fitted.features
    train = fitted.data.filter(~F.col("is_test")).select([f + TR.Z for f in feats] + ["REINGRESO", "weight"]).toPandas()
    beta = _newton_lr(train[[f + TR.Z for f in feats]].to_numpy(), train["REINGRESO"].to_numpy(),
                      train["weight"].to_numpy())
    lr = fitted.lr.stages[-1]
    got = np.append(lr.coefficients.toArray(), lr.intercept)
    assert np.allclose(got, beta, atol=1e-5)


def test_probabilities_and_export(spark, fitted):
    out = TR.score_all(fitted)
    stats = out.agg(*[F.min(c).alias(f"lo_{c}") for c in ("PROB_REINGRESO_LR", "PROB_REINGRESO_RF",
                                                          "PROB_REINGRESO_GB")],
                    *[F.max(c).alias(f"hi_{c}") for c in ("PROB_REINGRESO_LR", "PROB_REINGRESO_RF",
                                                          "PROB_REINGRESO_GB")]).first()
    assert all(0.0 <= v <= 1.0 for v in stats)
    from carelens.plans.scoring import export_projection
    exp = export_projection(out, "batch", fitted.best)
    assert len(exp.columns) == len(BATCH_EXPORT) + 1 and exp.count() == I.prepared(spark, SF0001).count()


def test_weights_sum_to_100(spark, fitted):
    w = TR.variable_weights(spark, fitted).toPandas()
    for c in ("Peso_RegLogistica_%", "Peso_RandomForest_%", "Peso_GradientBoosting_%", "Peso_Promedio_%"):
        assert abs(w[c].sum() - 100.0) < 1e-6


def test_best_model_is_max_auc(fitted):
    assert fitted.aucs[fitted.best] == max(fitted.aucs.values())


def test_stream_scores_every_arriving_admission(spark, fitted, tmp_path):
    from carelens.streaming.score_stream import score_stream
    from carelens.sources.episodes import SOURCE_SCHEMA
    source, sink, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    eps = I.episodes(spark, SF0001).select(*[f.name for f in SOURCE_SCHEMA.fields])
    eps.write.parquet(source)
    q = score_stream(spark, fitted, source, sink, checkpoint_location=ckpt)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == eps.count()
    batch = TR.score_all(fitted).select("INGRESO_ACTUAL", "PROB_REINGRESO_LR")
    score_stream(spark, fitted, source, sink, checkpoint_location=ckpt).awaitTermination(300)
    assert spark.read.parquet(sink).count() == eps.count()      # a restart adds no row twice
    joined = out.join(batch, "INGRESO_ACTUAL").select(
        F.max(F.abs(F.col("PROBABILIDAD_REG_LOGISTICA") - F.col("PROB_REINGRESO_LR")))).first()[0]
    assert joined < 1e-9


def test_pipeline_writes_all_tables(spark, tmp_path):
    from carelens.plans.pipeline import load, run, score_saved
    out = str(tmp_path / "job")
    fitted = run(spark, load(spark, SF0001), out, Config("batch"))
    scored = spark.read.parquet(f"{out}/scored")
    assert scored.count() == I.prepared(spark, SF0001).count()
    csv = lambda name: spark.read.option("header", True).csv(f"{out}/{name}")
    n = len(fitted.features)
    for name, rows in (("variable_weights", n), ("importance_rf", n), ("importance_gb", n), ("coefficients_lr", n),
                       ("correlation_matrix", (n + 1) ** 2), ("target_correlation", n), ("model_metrics", 3)):
        assert csv(name).count() == rows
    assert csv("scored_csv").count() == scored.count()
    again = score_saved(spark, load(spark, SF0001), f"{out}/models")
    cols = ["INGRESO_ACTUAL", "PROBABILIDAD_REINGRESO_MEJOR_MODELO", "NIVEL_RIESGO_REINGRESO", "MODELO_USADO"]
    assert sorted(again.select(cols).collect()) == sorted(scored.select(cols).collect())


def test_same_seed_same_result_and_stationary(spark, fitted):
    again = TR.fit(spark, I.prepared(spark, SF0001), Config("batch"))
    assert again.best == fitted.best and again.aucs == fitted.aucs
    key = lambda f: sorted(TR.probabilities(f, f.data).select("INGRESO_ACTUAL", "PROB_REINGRESO_RF", "PROB_REINGRESO_GB").collect())
    assert key(again) == key(fitted)
    assert all(r.gradient == 0 for r in TR.lr_gradient(spark, fitted).collect())


def _trees(f):
    return [m.stages[-1].toDebugString.split("\n", 1)[1] for m in (f.rf, f.gb)]


def test_fits_repeat_on_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(TR, "TRAIN_ROWS_PER_PARTITION", 250)
    small = dict(trees=12, rounds=5)
    prepared = I.prepared(spark, SF0001).checkpoint()
    once = TR.fit(spark, prepared, Config("batch"), **small)
    train = once.data.filter(~F.col("is_test"))
    assert TR.training_rows(train, once.features, train.count()).rdd.getNumPartitions() >= 4
    again = TR.fit(spark, prepared, Config("batch"), **small)
    other = TR.fit(spark, prepared.repartition(13, F.rand(5)), Config("batch"), **small)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spread = TR.fit(spark, prepared.orderBy(F.desc("INGRESO_ACTUAL")), Config("batch"), **small)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert _trees(once) == _trees(again) == _trees(other) == _trees(spread)


def test_training_partitions_do_not_grow_with_every_row(spark, fitted):
    parts = [TR.training_partition_count(n) for n in (1, 15_000, 105_000, 540_000, 630_000, 6_300_000, 37_800_000, 10 ** 9)]
    assert parts == [1, 1, 7, 36, 36, 36, 76, 2000]
    assert all(TR.training_partition_count(n) <= TR.training_partition_count(6 * n) <= 6 * TR.training_partition_count(n)
               for n in (1, 14_999, 100_000, 600_000, 10 ** 7))
    rows = TR.training_rows(fitted.data.filter(~F.col("is_test")), fitted.features, 1000)
    assert set(rows.columns) == {"INGRESO_ACTUAL", "REINGRESO", "weight", TR.TREE_WEIGHT, *fitted.features, *(f + TR.Z for f in fitted.features)}


def test_source_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    prepared = I.prepared(spark, SF0001)
    n = prepared.count()
    source = prepared.mapInArrow(counted, prepared.schema)
    data, weights, fill = TR.model_ready(source, Config("batch"))
    TR.scaler_stats(data.filter(~F.col("is_test")), TR.C.BATCH_FEATURES)
    assert data.agg(F.count("weight")).first()[0] == read.value == n


def test_fits_run_together(spark, monkeypatch):
    from threading import Barrier
    met, real = Barrier(3), TR.Pipeline.fit

    def meet(self, *args):
        met.wait(60)                # broken unless all three have begun
        return real(self, *args)

    monkeypatch.setattr(TR.Pipeline, "fit", meet)
    together = TR.fit(spark, I.prepared(spark, SF0001), Config("batch"), trees=5, rounds=3)
    monkeypatch.undo()
    train = TR.training_rows(together.data.filter(~F.col("is_test")), together.features, 1)
    for alone in (together.rf, together.gb):
        copy = alone.stages[-1]
        kind = TR.RandomForestClassifier() if alone is together.rf else TR.GBTClassifier()
        raw = TR._assemblers(together.features)[0]
        params = {p.name: v for p, v in copy.extractParamMap().items() if kind.hasParam(p.name)}
        again = TR.Pipeline(stages=[raw, kind._set(**params)]).fit(train)
        assert again.stages[-1].toDebugString.split("\n", 1)[1] == copy.toDebugString.split("\n", 1)[1]


def test_test_rows_are_scored_once(fitted):
    plan = TR.test_predictions(fitted)._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan                        # read back, not scored again by every evaluation
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(fitted.tested) == key(TR.test_probabilities(fitted))


def test_training_rows_carry_no_lineage(spark, monkeypatch):
    seen, real = [], TR.fit_together
    monkeypatch.setattr(TR, "fit_together", lambda e, train: seen.append(train) or real(e, train))
    TR.fit(spark, I.prepared(spark, SF0001), Config("batch"), trees=3, rounds=2)
    assert len(seen[0]._jdf.queryExecution().analyzed().toString().strip().split("\n")) == 1


def test_prepared_rows_run_in_methods_that_are_compiled(spark, monkeypatch):
    name, prepared = "spark.sql.codegen.hugeMethodLimit", I.prepared(spark, SF0001)
    before, limits, real = spark.conf.get(name, None), [], type(prepared).checkpoint
    monkeypatch.setattr(type(prepared), "checkpoint", lambda self, *a, **k: limits.append(spark.conf.get(name, None)) or real(self, *a, **k))
    TR.model_ready(prepared, Config("batch"))
    assert limits[0] == "8000" and spark.conf.get(name, None) == before
    with pytest.raises(ZeroDivisionError), jit_sized_methods(spark):
        1 / 0
    assert spark.conf.get(name, None) == before


def test_rows_are_dealt_by_their_id(spark):
    from carelens.operators.deal import deal, exact_weight
    df = spark.range(1000).select(F.when(F.col("id") % 100 < 99, F.col("id")).alias("k"), (F.col("id") % 7).alias("v"))
    seen = lambda d: [[tuple(r) for r in part] for part in d.rdd.glom().collect()]
    a, b = (seen(deal(x, "k", 6, ["v"])) for x in (df, df.repartition(3, "v").orderBy(F.desc("v"))))
    assert a == b and len(a) == 6 and min(map(len, a)) > 100
    assert all(p == sorted(p, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for p in a)
    assert not any(seen(deal(df.filter("v > 9"), "k", 4)))
    w = spark.createDataFrame([(1 / 3,), (2.9,), (1e-9,)], "weight double").select(exact_weight("weight").alias("w")).collect()
    assert [r.w * 65536 for r in w] == [21845.0, 190054.0, 1.0]


def test_planted_signal_is_found(spark):
    planted = I.prepared(spark, SF0001).withColumn("REINGRESO", F.coalesce(F.col("DURACION_ESTANCIA_ACTUAL") % 2 == 0, F.lit(False)).cast("int")).withColumn(
        "EDAD", F.when(F.col("REINGRESO") == 1, F.col("EDAD") + 25).otherwise(F.col("EDAD")))
    assert min(TR.fit(spark, planted, Config("batch"), trees=20, rounds=10).aucs.values()) > 0.6


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError, match="both classes"):
        TR.fit(spark, I.prepared(spark, SF0001).withColumn("REINGRESO", F.lit(0)), Config("batch"))
