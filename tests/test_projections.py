"""Projection / label / union helpers."""

from pyspark.sql import functions as F

from foldframe.operators import blend, features, folds


def test_split_features_and_categoricals(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 1.0, 0)], "id long, c string, x double, z double, label int")
    feats, label = features.split_features_label(df, "label")
    assert feats == ["c", "x", "z"] and label == "label"
    assert features.categorical_columns(df) == ["c"]
    assert features.select_stat_columns(df, "label", exclude=["z"]) == ["c", "x"]
    assert features.select_stat_columns(df, "label", strings_only=True) == ["c"]
    assert features.select_stat_columns(df, "label", only=["x", "nope"]) == ["x"]


def test_cast_map_fill_rename_drop(spark):
    df = spark.createDataFrame([(1, 1.0, "Presence", None, 0.4), (2, 0.0, "Absence", 0.2, 0.4),
                                (3, 0.0, "Other", None, 0.4)], "id long, y double, hd string, e double, gm double")
    out = features.cast_label(df, "y")
    assert dict(out.dtypes)["y"] == "int"
    m = features.map_label(df, "hd", {"Absence": 0, "Presence": 1}).orderBy("id").toPandas()
    assert m["hd"].tolist()[:2] == [1, 0] and m["hd"].isna().tolist()[2]
    f = features.fill_default(df, ["e"], "gm").orderBy("id").toPandas()
    assert f["e"].tolist() == [0.4, 0.2, 0.4]
    r = features.rename_prediction(df, {"e": "e_mean"})
    assert "e_mean" in r.columns and "e" not in r.columns
    assert "hd" not in features.drop_encoded_sources(df, ["hd"]).columns


def test_train_valid_split_and_union(spark):
    df = folds.assign_kfold(spark.range(50), k=5)
    tr, va = folds.train_valid_split(df, 2)
    assert tr.count() == 40 and va.count() == 10
    assert folds.filter_fold(df, 2).count() == 10
    parts = [folds.filter_fold(df, i) for i in range(5)]
    assert features.union_folds(parts).count() == 50


def test_stack_predictions_pivot(spark):
    long = spark.createDataFrame([(1, "m1", 0.1), (1, "m2", 0.2), (2, "m1", 0.3), (2, "m2", 0.4)],
                                 "id long, model string, pred double")
    wide = blend.stack_predictions(long, ["m1", "m2"]).orderBy("id").toPandas()
    assert wide.columns.tolist() == ["id", "m1", "m2"]
    assert wide["m2"].tolist() == [0.2, 0.4]


def test_augment_after_fold_filter(spark):
    train = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0)], "id long, fold int, x double")
    ext = spark.createDataFrame([(10, 5.0, "extra")], "student_id long, x double, junk string")
    tr_part = train.filter(F.col("fold") != 0)
    out = features.augment_train(tr_part, ext, rename={"student_id": "id"}).orderBy("id").toPandas()
    assert out["is_generated"].tolist() == [1, 0]
    assert "junk" not in out.columns
