import random

from pyspark.sql import functions as F

from tabsight.plans import analysis
from tabsight.session import checkpoint_dir
from tabsight.sources.catalog import Catalog


def test_run_persist_and_evidence_view(spark):
    rng = random.Random(8)
    rows = []
    for i in range(180):
        x = rng.random()
        rows.append((x, rng.choice(["a", "b", "c"]), None if i % 20 == 3 else 1 if x + rng.random() * 0.6 > 0.9 else 0))
    df = spark.createDataFrame(rows, "score_a double, segment string, churn int")
    r = analysis.run_analysis(spark, df, "classify churn", "churn", candidates=["LogisticRegression", "Baseline"])
    assert r.task["problem_type"] == "classification" and r.champion in ("LogisticRegression", "Baseline")
    # rows without a label are counted and left out
    gone = r.alerts.where("alert_type = 'missing_target'").first()
    assert gone["column"] == "churn" and gone["metric"] == 5.0 and gone["message"].startswith("9 of 180 rows")
    assert sum(e.oof.count() for e in r.extra["experiments"][:1]) + r.extra["predictions"].count() == 171
    cutoffs = {x["cutoff"] for x in r.holdout.select("cutoff").distinct().collect()}
    assert "default_0.50" in cutoffs
    root = checkpoint_dir(spark).rstrip("/") + "/catalog-run-" + str(rng.random())[2:]
    cat = Catalog(spark, root)
    aid = cat.persist_run(r, "ds1", "classify churn")
    ev = cat.evidence(dataset_id="ds1").first()
    assert ev["id"] == aid and len(ev["experiments"]) == 2
    assert "test" in ev["champion_metrics"] and "roc_auc" in ev["champion_metrics"]["test"]
    counts = {x["table_name"]: x["n"] for x in cat.counts().collect()}
    assert counts["analysis_runs"] == 1 and counts["experiments"] == 2
    assert cat.read("run_params").where(F.col("param") == "preset").count() == 2
    # the stored run leads to a champion that scores like the one that was fitted
    from tabsight.operators import models
    model = cat.read("models").where("is_best").first()
    assert ev["final_model_id"] == model["id"] and ev["champion_metrics"] and ev["artifact_path"] == model["artifact_path"]
    champ = next(e for e in r.extra["experiments"] if e.name == r.champion)
    raw = df.withColumn("k", F.monotonically_increasing_id())
    raw = raw.drop("churn")
    one, two = (models.score(e, raw, "k").select("k", "p").orderBy("k").collect() for e in (champ, models.load_model(spark, model["artifact_path"])))
    assert one == two
    report = cat.read("reports").first()
    assert cat.evidence(report_id=report["id"]).first()["id"] == aid and report["full_report_markdown"].startswith("# Analysis")
    board = cat.dashboard().collect()
    assert [(x["dataset_id"], x["model_name"], x["problem_type"]) for x in board] == [("ds1", r.champion, "classification")]
    prof = cat.register_profile("ds1", df, "churn").first()
    assert prof["inferred_problem_type"] and '"churn"' in prof["candidate_targets"]
