"""Written tables: scopes, resume and checked broadcasts."""

import pytest

from linkloom import scratch


def test_a_scope_removes_what_it_wrote(spark):
    outside = scratch.scratch_path(spark, "outside")
    with scratch.scope(spark):
        inner = scratch.materialise(spark.range(10), "inner")
        with scratch.scope(spark):
            nested = scratch.scratch_path(spark, "nested")
            spark.range(3).write.parquet(nested)
        assert not scratch.exists(spark, nested)
        kept = scratch.stored(inner.where("id > 4"), outside)
    paths = inner.inputFiles()
    assert paths and not any(scratch.exists(spark, p) for p in paths)
    assert kept.count() == 5


def test_stored_tables_are_not_written_again(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert scratch.stored(spark.range(4), path).count() == 4
    assert scratch.stored(spark.range(9), path).count() == 4
    (tmp_path / "table" / "_SUCCESS").unlink()
    assert scratch.stored(spark.range(9), path).count() == 9


def test_only_small_tables_are_marked_for_broadcast(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(scratch.bounded(spark.range(10), 10)) and not hinted(scratch.bounded(spark.range(11), 10))


@pytest.mark.parametrize("write", [lambda df, path: scratch.materialise(df, "rows"), scratch.stored, lambda df, path: scratch.dealt(df, "rows", "at")])
def test_shuffle_files_go_with_the_write(spark, tmp_path, write):
    """What is written leaves no shuffle files behind, and the session's setting is as before."""
    jvm, setting = spark.sparkContext._jvm, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    held = lambda: {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(files()) if f.getName().startswith("shuffle_")}
    before, was = held(), spark.conf.get(setting, None)
    rows = spark.range(1000).selectExpr("id % 7 AS at", "id").repartition(4, "at").groupBy("id", "at").count()
    assert len(write(rows, f"file://{tmp_path}/rows").collect()) == 1000
    assert held() <= before and spark.conf.get(setting, None) == was
