"""Run-metrics edges."""
import math

from wordloom.operators import metrics as mt


def test_running_best_strict(spark):
    log = spark.createDataFrame([("r", 1, 3.0), ("r", 2, 2.0), ("r", 3, 2.0), ("r", 4, 1.5)],
                                "run string, step long, val_avg double")
    flags = [r.is_best for r in mt.running_best(log).orderBy("step").collect()]
    assert flags == [True, True, False, True]                 # equal to the best is not a new best


def test_dedup_keeps_last(spark):
    log = spark.createDataFrame([("r", 10, 1, 5.0), ("r", 10, 7, 4.0), ("r", 20, 3, 3.0)],
                                "run string, step long, ingest_seq long, val_avg double")
    got = {r.step: r.val_avg for r in mt.dedup_resumed(log).collect()}
    assert got == {10: 4.0, 20: 3.0}


def test_schedule_matches_python():
    sched = mt.Schedule(8e-4, 8e-5, 200, 6000)

    def lr_at(step):
        if step < 200:
            return 8e-4 * (step + 1) / 200
        if step >= 6000:
            return 8e-5
        ratio = (step - 200) / max(1, 6000 - 200)
        return 8e-5 + 0.5 * (1.0 + math.cos(math.pi * ratio)) * (8e-4 - 8e-5)
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.range(0, 6100, 37).withColumnRenamed("id", "step")
    for r in df.select("step", sched.at(df.step).alias("lr")).collect():
        assert math.isclose(r.lr, lr_at(r.step), rel_tol=1e-12)
