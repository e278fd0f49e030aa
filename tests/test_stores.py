"""Replacing tables and sets as a whole, and streams that are killed midway."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import treeshap
from holdfast.plans import artifacts
from holdfast.sources import tables, versions
from holdfast.streaming import monitor, scoring


def _ids(table):
    return sorted(r[0] for r in table.collect())


def test_readers_see_the_old_table_until_the_new_one_is_complete(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(5), path)
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(broken, path)
    assert _ids(tables.read_table(spark, path)) == list(range(5))
    reader = tables.read_table(spark, path)
    tables.replace_table(spark.range(10, 12), path)
    assert _ids(tables.read_table(spark, path)) == [10, 11] and _ids(reader) == list(range(5))  # also who still reads the old one


def test_a_table_is_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(4), path)
    for _ in range(3):
        old = tables.read_table(spark, path)
        tables.replace_table(old.union(old.select(F.col("id") + 100)), path)
    assert tables.read_table(spark, path).count() == 32
    assert len(list((tmp_path / "t").glob("version-*"))) == 2  # the current one and the one before


def test_a_write_that_loses_rows_is_not_published(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(4), path)
    monkeypatch.setattr(tables, "write_table", lambda df, folder: (_ for _ in ()).throw(RuntimeError("rows lost")))
    with pytest.raises(RuntimeError):
        tables.replace_table(spark.range(9), path)
    assert tables.read_table(spark, path).count() == 4


@pytest.fixture(scope="module")
def exported(study, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("set") / "study")
    study.export(path, cross_validation=False)
    return path


def test_a_set_is_loaded_as_it_was_written(study, spark, exported):
    found = artifacts.load_artifacts(spark, exported)
    assert found.feature_names == study.features.feature_names
    assert found.tables["contributions"].count() == study.test.count() and found.reports["test_metrics"].count() == 2
    with pytest.raises(artifacts.ArtifactError):
        artifacts.load_artifacts(spark, exported + "-none")


@pytest.mark.parametrize("change", ["contributions", "base", "features", "rows", "order"])
def test_parts_that_do_not_belong_together_are_an_error(study, spark, exported, change):
    about = versions.current(spark, exported)
    folder = versions.new_folder(exported)
    place, store = versions.file_system(spark, about["folder"])
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, place, store, spark._jvm.org.apache.hadoop.fs.Path(folder), False, spark.sparkContext._jsc.hadoopConfiguration())
    table = tables.read_table(spark, f"{about['folder']}/contributions")
    if change == "contributions":
        tables.write_table(table.withColumn("shap", F.reverse("shap")).withColumn("log_odds", F.col("log_odds") + 0.5), f"{folder}/contributions")
    elif change == "base":
        tables.write_table(table.withColumn("base", F.col("base") + 1).withColumn("log_odds", F.col("log_odds") + 1), f"{folder}/contributions")
    elif change == "features":
        other = tables.read_table(spark, f"{about['folder']}/train")
        tables.write_table(other.drop(other.columns[3]), f"{folder}/train")
    elif change == "rows":
        tables.write_table(tables.read_table(spark, f"{about['folder']}/scored").limit(10), f"{folder}/scored")
    else:
        about["features"] = about["features"][::-1]
    with pytest.raises(artifacts.ArtifactError):
        artifacts.load(spark, folder, about)


def test_a_killed_batch_is_repeated_without_loss_or_repetition(study, spark, monkeypatch):
    """Killed after the scores of a batch were written, before its rejects."""
    source, scores, rejects, log = (tables.fresh_path(spark, n) for n in ("in", "scores", "rejects", "log"))
    odd = study.customers.withColumn("Income_Category", F.when(F.col("CLIENTNUM") % 7 == 0, "?").otherwise(F.col("Income_Category")))
    tables.write_table(odd.repartition(4), source)
    write, killed = scoring._write_batch, []

    def once(rows, folder, batch):
        if folder == rejects and batch == 1 and not killed:
            killed.append(batch)
            raise RuntimeError("killed")
        write(rows, folder, batch)

    monkeypatch.setattr(scoring, "_write_batch", once)

    def run():
        scoring.stream_to_sinks(spark, source, odd.schema, study.pipeline, study.nodes, 20.0, scores, rejects, log, 2).awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    records, left = spark.read.parquet(scores), spark.read.parquet(rejects)
    good = study.customers.filter("CLIENTNUM % 7 <> 0")
    assert records.count() == 2 * good.count() == records.select("CLIENTNUM", "model").distinct().count()
    assert _ids(left.select("CLIENTNUM")) == _ids(study.customers.filter("CLIENTNUM % 7 = 0").select("CLIENTNUM"))
    assert left.filter("array_contains(missing, 'Income_Category')").count() == left.count()
    batch = scoring.explained_scores(good, study.pipeline, treeshap.collected_paths(treeshap.tree_paths(study.nodes)), 20.0)
    columns = ["CLIENTNUM", "model", "p", "tier", "log_odds", "base", "shap", "steps"]
    assert sorted(map(str, records.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))


def test_only_new_files_are_measured(spark, tmp_path):
    source, store, log = (str(tmp_path / n) for n in ("in", "store", "log"))
    table = spark.range(20_000).select("id", F.when(F.col("id") % 4 == 0, "x").alias("a"))

    def run():
        monitor.measure_arrivals(spark, source, table.schema, "id", store, log).awaitTermination()
        return monitor.report(spark.read.parquet(store)).first()

    table.filter("id < 15000").write.parquet(source)
    first = run()
    assert first["n_rows"] == 15_000 and first["may_be_unique"] == 1 and first["n_missing"] == {"id": 0, "a": 11_250}
    table.filter("id >= 15000").write.mode("append").parquet(source)
    second = run()
    assert second["n_rows"] == 20_000 and abs(second["keys_estimated"] - 20_000) <= 4 * monitor.error() * 20_000
    assert sorted(r["n_rows"] for r in spark.read.parquet(store).collect()) == [5_000, 15_000]
    table.filter("id < 3000").write.mode("append").parquet(source)
    third = run()
    assert third["n_rows"] == 23_000 and third["may_be_unique"] == 0


def test_measures_of_nothing_and_without_keys(spark):
    empty = spark.createDataFrame([], "id long, a string")
    row = monitor.report(monitor.measured(empty, "id")).first()
    assert (row["n_rows"], row["keys_estimated"]) == (0, 0)
    row = monitor.report(monitor.measured(spark.createDataFrame([(None, "x"), (1, None)], "id long, a string"), "id")).first()
    assert (row["n_rows"], row["n_without_key"], row["may_be_unique"], row["n_missing"]) == (2, 1, 0, {"id": 1, "a": 1})


def test_intermediate_tables_are_deleted_when_asked(spark, tmp_path):
    before = tables.settle(spark.range(3), "kept")
    mark = tables.stored_so_far(spark)
    made = [tables.settle(spark.range(n), "made") for n in (4, 5)]
    tables.replace_table(made[0].union(made[1]), str(tmp_path / "result"))
    files = [f for t in made for f in t.inputFiles()]
    tables.clear_since(spark, mark)
    assert tables.stored_so_far(spark) == mark and before.count() == 3
    assert not any(versions.file_system(spark, f)[1].exists(versions.file_system(spark, f)[0]) for f in files)
    assert tables.read_table(spark, str(tmp_path / "result")).count() == 9
