"""Commits of the run catalog: all or nothing, ids that come back, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from tabsight.session import checkpoint_dir
from tabsight.sources.catalog import Catalog

MANIFEST = "id string, name string, file_path string, file_type string, size_bytes long, row_count long, col_count long, checksum string"


@pytest.fixture
def cat(spark):
    return Catalog(spark, f"{checkpoint_dir(spark).rstrip('/')}/commits-{random.random()}")


def _dataset(spark, i, checksum):
    return spark.createDataFrame([(i, "n" + i, "p", "csv", 1, 1, 1, checksum)], MANIFEST)


def _run(spark, i, dataset):
    row = {"id": i, "dataset_id": dataset, "status": "COMPLETED"}
    names = "id dataset_id user_goal status problem_type target_column time_column validation_strategy final_model_id critic_findings_json".split()
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], ", ".join(f"{n} string" for n in names))
    return df.withColumn("created_at", F.current_timestamp()).withColumn("completed_at", F.current_timestamp())


def test_a_commit_shows_whole_or_not_at_all(spark, cat):
    assert cat.read("datasets").count() == 0 and cat.manifests() == []
    with pytest.raises(RuntimeError):
        with cat.commit() as c:
            c.append("analysis_runs", _run(spark, "r1", "d1"))
            raise RuntimeError("the writer dies")
    assert cat.read("analysis_runs").count() == 0 and cat.manifests() == []
    with cat.commit() as c:
        c.append("analysis_runs", _run(spark, "r1", "d1"))
        c.append("analysis_runs", _run(spark, "r2", "d1"))
        assert cat.read("analysis_runs").count() == 0  # not before it is published
    assert {r["id"] for r in cat.read("analysis_runs").collect()} == {"r1", "r2"} and len(cat.manifests()) == 1


def test_a_deleted_id_can_come_back(spark, cat):
    cat.register_datasets(_dataset(spark, "d1", "a"))
    cat.append("analysis_runs", _run(spark, "r1", "d1"))
    cat.delete("datasets", cat.read("datasets").select("id"))
    assert cat.read("datasets").count() == 0 and cat.read("analysis_runs").count() == 0
    cat.register_datasets(_dataset(spark, "d1", "b"))
    cat.append("analysis_runs", _run(spark, "r2", "d1"))
    for _ in range(2):
        assert [(r["id"], r["checksum"]) for r in cat.read("datasets").collect()] == [("d1", "b")]
        assert [r["id"] for r in cat.read("analysis_runs").collect()] == ["r2"]
        cat.compact()
    last = cat.manifests()[-1]
    assert last["deleted"] == [] and len(last["added"]) == 2
    cat.delete("analysis_runs", cat.read("analysis_runs").select("id"))
    assert cat.read("analysis_runs").count() == 0 and cat.read("datasets").count() == 1


def test_the_most_specific_id_wins(spark, cat):
    cat.append("analysis_runs", _run(spark, "r1", "d1"))
    cat.append("analysis_runs", _run(spark, "r2", "d1"))
    cat.append("analysis_runs", _run(spark, "r3", "d2"))
    assert {r["id"] for r in cat.evidence().collect()} == {"r2", "r3"}
    assert [r["id"] for r in cat.evidence(dataset_id="d1").collect()] == ["r2"]
    assert [r["id"] for r in cat.evidence(dataset_id="d1", analysis_id="r1").collect()] == ["r1"]
    assert [r["id"] for r in cat.evidence(dataset_id="d1", analysis_id="none").collect()] == ["r2"]
    both = cat.evidence(analysis_id="r1", comparison_id="r3").first()
    assert both["id"] == "r1" and both["comparison"]["id"] == "r3" and both["comparison"]["dataset_id"] == "d2"


def _metric(spark, run):
    names = "id experiment_id analysis_id metric_name".split()
    df = spark.createDataFrame([(f"{run}:m1:auc", f"{run}:m1", run, "auc")], ", ".join(f"{n} string" for n in names))
    return df.withColumns({"metric_value": F.lit(0.5), "split_type": F.lit("test"), "created_at": F.current_timestamp()})


def test_rows_are_joined_only_by_keys_that_were_deleted(spark, cat):
    cat.register_datasets(_dataset(spark, "d1", "a"))
    for i, d in (("r1", "d1"), ("r2", "d2")):
        cat.append("analysis_runs", _run(spark, i, d))
        cat.append("experiment_metrics", _metric(spark, i))

    def joins(name):  # one broadcast join numbers the commits of the rows, one those of each deleted key
        return cat.read(name)._jdf.queryExecution().optimizedPlan().toString().count("LeftOuter")
    assert joins("experiment_metrics") == 0
    cat.delete("datasets", cat.read("datasets").select("id"))
    assert joins("experiment_metrics") == 1 and joins("analysis_runs") == 1
    assert [r["analysis_id"] for r in cat.read("experiment_metrics").collect()] == ["r2"]
    assert [r["analysis_id"] for r in cat.read("experiment_metrics", spark.createDataFrame([("r1",), ("r2",)], "analysis_id string")).collect()] == ["r2"]
    cat.compact()
    assert joins("experiment_metrics") == 0 and [r["id"] for r in cat.read("analysis_runs").collect()] == ["r2"]
    assert not any("/datasets/" in p for p in cat.manifests()[-1]["added"])  # nothing of it is alive
