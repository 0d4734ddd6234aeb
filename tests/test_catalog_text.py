import random

from pyspark.sql import functions as F

from tabsight.operators import evidence as EV
from tabsight.operators import explain, models, split as SP
from tabsight.session import checkpoint_dir
from tabsight.sources.catalog import Catalog


def test_numbered_items_and_markdown_tables(spark):
    text = "Risks:\n1. Leakage from duration\n2) Imbalance\nnot a list 3. x\n\n| metric | value |\n|---|---|\n| auc | 0.91 |\n"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    items = df.select(EV.numbered_items(F.col("text")).alias("i")).first()["i"]
    assert items == ["Leakage from duration", "Imbalance"]
    rows = EV.markdown_table_rows(df, "text", ["id"]).orderBy("line_no").collect()
    assert [r["cells"] for r in rows] == [["metric", "value"], ["auc", "0.91"]]


def test_latest_per_key_and_pagination(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 2, "w")], "k string, t int, v string")
    got = {r["key"]: r["v"] for r in EV.latest_per_key(df, "k", ["t"]).collect()}
    assert got == {"a": "y", "b": "z"}
    page = EV.paginate(df, [F.col("t").desc(), F.col("v")], offset=1, limit=2).collect()
    assert [r["t"] for r in page] == [2, 2]


def _small_run(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.choice(["u", "v"]), 1.0 if rng.random() < 0.4 else 0.0) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, f double, c string, label double")
    sp = SP.holdout_split(df, "id", "label", 0.2)
    tr = sp.where("split='train'").drop("split")
    cv = models.prepare_cv(tr, "id", ["f"], ["c"], "classification", 3)
    return models.train_candidate("LogisticRegression", "classification", cv, 2, ["0", "1"]), tr


def test_permutation_importance_runs_distributed(spark):
    exp, tr = _small_run(spark)
    imp = {r["feature"]: r for r in explain.permutation_importance(exp, tr, "id").collect()}
    assert set(imp) == {"f", "c"}
    assert all(r["base_score"] is not None for r in imp.values())


def test_catalog_register_and_delete(spark):
    root = checkpoint_dir(spark).rstrip("/") + "/catalog-test-" + str(random.random())[2:]
    cat = Catalog(spark, root)
    man = spark.createDataFrame([("d1", "p1", "csv", 10, 5, 2, "aaa"), ("d2", "p2", "parquet", 20, 7, 3, "bbb")],
                                "name string, file_path string, file_type string, size_bytes long, row_count long, "
                                "col_count long, checksum string")
    assert cat.register_datasets(man).count() == 2
    assert cat.register_datasets(man).count() == 0  # same checksums: nothing new
    counts = {r["table_name"]: r["n"] for r in cat.counts().collect()}
    assert counts["datasets"] == 2
    ids = cat.read("datasets").where(F.col("name") == "d1").select("id")
    cat.delete("datasets", ids)
    assert [r["name"] for r in cat.read("datasets").collect()] == ["d2"]


def test_save_model_and_decode_labels(spark):
    import os
    from pyspark.ml.classification import LogisticRegressionModel
    exp, tr = _small_run(spark)
    path = checkpoint_dir(spark).rstrip("/") + "/model-test-" + str(random.random())[2:]
    models.save_model(exp, path)
    loaded = LogisticRegressionModel.load(path + "/stage_0")
    assert loaded.numFeatures == exp.model.stages[0].numFeatures
    pred = exp.model.predict(exp.preprocessor.transform(tr))
    dec = models.decode_labels(pred, ["no", "yes"])
    assert set(r["predicted_label"] for r in dec.select("predicted_label").distinct().collect()) <= {"no", "yes"}


def test_delimiter_inference_per_file(spark):
    from tabsight.sources import readers as R
    base = checkpoint_dir(spark).rstrip("/") + "/delims-" + str(random.random())[2:]
    local = base[len("file:"):] if base.startswith("file:") else base
    import os
    os.makedirs(local, exist_ok=True)
    for name, d in [("comma", ","), ("semi", ";"), ("tab", "\t"), ("pipe", "|")]:
        with open(os.path.join(local, f"{name}.csv"), "w") as fh:
            fh.write(d.join(["a", "b", "c"]) + "\n")
            for i in range(30):
                fh.write(d.join([str(i), f"x{i}", str(i * 1.5)]) + "\n")
    got = {r["path"].rsplit("/", 1)[-1]: r["delimiter"] for r in R.detect_delimiters(spark, local).collect()}
    assert got == {"comma.csv": ",", "semi.csv": ";", "tab.csv": "\t", "pipe.csv": "|"}
    df = R.load_dataset(spark, os.path.join(local, "semi.csv"))
    assert df.columns == ["a", "b", "c"] and df.count() == 30


def _folder(spark, name):
    import os
    base = checkpoint_dir(spark).rstrip("/") + f"/{name}-" + str(random.random())[2:]
    local = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(local, exist_ok=True)
    return local


def test_mixed_delimiters_and_json_lines_lose_no_row(spark):
    import os
    from tabsight.sources import readers as R
    local = _folder(spark, "mixed")
    for name, d in [("comma", ","), ("semi", ";")]:
        with open(os.path.join(local, f"{name}.csv"), "w") as fh:
            fh.write(d.join(["a", "b"]) + "\n" + "".join(d.join([str(i), f"x{i}"]) + "\n" for i in range(20)))
    df = R.load_dataset(spark, local)
    assert df.columns == ["a", "b"] and df.count() == 40 and df.where("b is null").count() == 0
    lines = os.path.join(_folder(spark, "lines"), "rows.json")
    with open(lines, "w") as fh:
        fh.write("".join('{"k": %d}\n' % i for i in range(100)))
    assert R.load_dataset(spark, lines).count() == 100


def test_delete_cascades_and_later_appends_keep_the_rest(spark):
    cat = Catalog(spark, _folder(spark, "catalog-cascade"))

    def add(run):
        cat.append("analysis_runs", spark.createDataFrame([(run, "d1", "COMPLETED")], "id string, dataset_id string, status string")
                   .selectExpr("*", *[f"cast(null as string) as {c}" for c in ("user_goal", "problem_type", "target_column", "time_column", "validation_strategy", "final_model_id", "critic_findings_json")],
                               "current_timestamp() as created_at", "current_timestamp() as completed_at"))
        cat.append("run_params", spark.createDataFrame([(run, f"{run}:m", "p", "v")], "analysis_id string, experiment_id string, param string, value string"))
    add("a")
    add("b")
    cat.delete("analysis_runs", spark.createDataFrame([("a",)], "id string"))
    add("c")
    for name, key in (("analysis_runs", "id"), ("run_params", "analysis_id")):
        assert sorted(r[key] for r in cat.read(name).collect()) == ["b", "c"]
    cat.delete("datasets", spark.createDataFrame([("d1",)], "id string"))
    assert cat.read("analysis_runs").count() == 0 and cat.read("run_params").count() == 0


def test_a_table_that_cannot_be_read_is_not_empty(spark):
    import pytest
    with pytest.raises(Exception):
        Catalog(spark, "nosuchscheme://x/y").read("datasets").count()


def test_permuted_pairs_rows_by_hash_order(spark):
    import hashlib

    def order(rows, text):
        return sorted(rows, key=lambda r: (int(hashlib.md5(text(r).encode()).hexdigest()[:8], 16), r[0]))

    rng = random.Random(4)
    rows = [(i, rng.random() if i % 7 else None, rng.choice(["u", "v", None])) for i in range(300)]
    got = explain.permuted(spark.createDataFrame(rows, "id long, f double, c string").repartition(5), "id", ["f", "c"]).collect()
    base = order(rows, lambda r: str(r[0]))
    want = {("", r) for r in rows}
    for j, name in ((1, "f"), (2, "c")):
        for own, other in zip(base, order(rows, lambda r: f"{r[0]}|perm{name}")):
            want.add((name, (*own[:j], other[j], *own[j + 1:])))
    assert len(got) == 900 and {(r[0], tuple(r)[1:]) for r in got} == want
    assert explain.permuted(spark.createDataFrame([], "id long, f double"), "id", ["f"]).count() == 0
    twice = spark.createDataFrame([(1, 5.0), (1, 6.0), (None, 7.0)], "id long, f double")
    assert sorted(r["f"] for r in explain.permuted(twice, "id", ["f"]).where("_permuted = 'f'").collect()) == [5.0, 6.0, 7.0]


def test_permutation_importance_finds_the_used_feature(spark):
    exp, tr = _small_run(spark)
    imp = {r["feature"]: r for r in explain.permutation_importance(exp, tr, "id").collect()}
    assert len({r["base_score"] for r in imp.values()}) == 1
    assert all(abs(r["importance"] - (r["base_score"] - r["permuted_score"])) < 1e-12 for r in imp.values())


def test_forecast_trajectory(spark):
    rows = [(t, float(t), None if t == 3 else t + 0.5) for t in range(130, 0, -1)] + [(None, 1.0, 1.0)]
    got = EV.forecast_trajectory(spark.createDataFrame(rows, "t int, y double, p double").repartition(4), "t", "y", "p").orderBy("step").collect()
    assert [(r["step"], r["t"]) for r in got] == [(i, i) for i in range(1, 121)]
    assert got[2]["predicted"] is None and got[3]["predicted"] == 4.5
