from vellum.session import session
from vellum.sources import sinks


def test_writes_and_dry_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    out = str(tmp_path / "t")
    assert sinks.write(df, out, dry_run=True) == 2 and not (tmp_path / "t").exists()
    assert sinks.write(df, out, by=("k",)) is None
    assert {tuple(r) for r in spark.read.parquet(out).select("id", "k").collect()} == {(1, "a"), (2, "b")}
    sinks.write(df, str(tmp_path / "c"), kind="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.replace(df.limit(1), out)
    assert spark.read.parquet(out).count() == 1
    assert session().conf.get("spark.sql.session.timeZone") == "UTC"
