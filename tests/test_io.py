"""Sources and sinks round trip."""

import pytest
from pyspark.sql import functions as F

from foldframe.sources import io


def test_oof_and_fold_tables_round_trip(spark, tmp_path):
    oof = spark.createDataFrame([(1, 0, 0.2, 1), (2, 1, 0.7, 0)], "id long, fold int, lgb_pred_1 double, y int")
    io.write_oof(oof, str(tmp_path / "oof"), fmt="csv")
    back = io.read_oof(spark, str(tmp_path / "oof"), "m1", fmt="csv")
    assert sorted(back.columns) == ["id", "m1", "y"]
    assert sorted(r["m1"] for r in back.collect()) == [0.2, 0.7]

    test = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6), (3, 0, 0.1)], "id long, fold int, lgb_pred_1 double")
    io.write_fold_predictions(test, str(tmp_path / "test"))
    assert {p.name for p in (tmp_path / "test").iterdir() if p.is_dir()} == {"fold=0", "fold=1"}
    ft = io.read_fold_predictions(spark, str(tmp_path / "test"), "m1")
    assert ft.filter(F.col("fold") == 1).count() == 1      # partition pruning on fold


def test_fold_predictions_need_ids(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.5)], "fold int, p double")
    df.write.parquet(str(tmp_path / "noid"))
    with pytest.raises(ValueError):
        io.read_fold_predictions(spark, str(tmp_path / "noid"), "m")


def test_read_table_and_reference_rename(spark, tmp_path):
    df = spark.createDataFrame([(5, "a", 1.0)], "student_id long, c string, exam_score double")
    df.write.option("header", "true").csv(str(tmp_path / "ref.csv"))
    ref = io.read_reference_table(spark, str(tmp_path / "ref.csv"), key_col="student_id")
    assert "id" in ref.columns and ref.first()["id"] == 5


def test_write_submission(spark, tmp_path):
    template = spark.createDataFrame([(1,), (2,)], "id long")
    preds = spark.createDataFrame([(1, 0.3)], "id long, pred double")
    sub = io.write_submission(template, preds, str(tmp_path / "sub"), "target")
    rows = {r["id"]: r["target"] for r in sub.collect()}
    assert rows == {1: 0.3, 2: None}


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    from foldframe.operators import blend
    rows = [(i, i % 5, i / 7, float(i % 2)) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, fold int, p double, y double")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # tables beyond any broadcast
    try:
        for keys, join in ((("id",), blend.join_oof), (("id", "fold"), blend.align_fold_predictions)):
            tables = []
            for i in range(3):
                path = str(tmp_path / f"{'_'.join(keys)}{i}")
                cols = [*keys, F.col("p").alias(f"p{i}"), *(["y"] if len(keys) == 1 else [])]
                io.write_bucketed(d.select(*cols), path, keys, buckets=4)
                tables.append(io.read_bucketed(spark, path, keys, buckets=4))
            out = join(tables)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            got = sorted((r["id"], r["p0"], r["p1"], r["p2"]) for r in out.collect())
            assert got == [(i, p, p, p) for i, _, p, _ in rows]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
