"""Readers turn NaN into NULL; landed-file ingest is incremental and does not duplicate on rerun."""

from pyspark.sql import functions as F

from eventide.sources import io
from eventide.streaming.landing import ingest_landed, read_ingested


def test_csv_nan_becomes_null(spark):
    path = io.scratch_path(spark, "nan")
    df = spark.createDataFrame([(1, float("nan")), (2, 3.5)], "id int, v double")
    io.write_table(df, path, "csv")
    back = io.read_csv(spark, path, "id int, v double")
    assert back.where(F.col("v").isNull()).count() == 1
    assert back.where(F.isnan("v")).count() == 0


def test_landing_is_incremental(spark):
    landing = io.scratch_path(spark, "landing")
    table_dir = io.scratch_path(spark, "landed")
    schema = "id int, v double"
    io.write_table(spark.createDataFrame([(i, float(i)) for i in range(10)], schema), f"{landing}/a", "csv")
    assert ingest_landed(spark, f"{landing}/*", table_dir, schema) == 10
    assert ingest_landed(spark, f"{landing}/*", table_dir, schema) == 10  # rerun: nothing new
    io.write_table(spark.createDataFrame([(i, float(i)) for i in range(10, 15)], schema), f"{landing}/b", "csv")
    assert ingest_landed(spark, f"{landing}/*", table_dir, schema) == 15
    assert sorted(r["id"] for r in read_ingested(spark, table_dir).collect()) == list(range(15))


def test_versions_latest_and_named(spark):
    root = io.scratch_path(spark, "ver")
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(1,), (2,)], "x int")
    io.write_version(a, root, "d", "v1")
    io.write_version(b, root, "d", "v2")
    assert io.read_version(spark, root, "d").count() == 2
    assert io.read_version(spark, root, "d", "v1").count() == 1
    assert [r["version"] for r in io.list_versions(spark, root, "d").orderBy("rank").collect()] == ["v2", "v1"]


def test_generic_model_roundtrip(spark):
    import numpy as np

    from eventide.operators.aft import aft_fit
    from eventide.operators.forest import rsf_fit
    from eventide.plans.q_models import cox_data
    from eventide.sources.models import load_model, save_model
    from tests.conftest import SF_SMALL
    data, feats = cox_data(spark, SF_SMALL)
    a = aft_fit(data, "t", "e", feats, "loglogistic", with_concordance=False)
    a2 = load_model(save_model(a, io.scratch_path(spark, "aft"), spark), spark)
    assert np.allclose(a.coef, a2.coef) and a2.dist == "loglogistic"
    r = rsf_fit(data, "t", "e", feats, "id", n_estimators=2, max_depth=2)
    r2 = load_model(save_model(r, io.scratch_path(spark, "rsf"), spark), spark)
    assert r.splits == r2.splits
    s1 = sorted((x["id"], round(x["risk"], 9)) for x in r.score(data, ["id"]).collect())
    s2 = sorted((x["id"], round(x["risk"], 9)) for x in r2.score(data, ["id"]).collect())
    assert s1 == s2
