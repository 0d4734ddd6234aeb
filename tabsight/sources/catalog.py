"""Run catalog as partitioned parquet tables.

Tables (fixed schemas): datasets, dataset_profiles, analysis_runs, experiments,
experiment_metrics, models, reports.  Every change is a commit: its rows and deleted keys
are written to folders of their own, and one small manifest file, renamed into place, makes
all of them visible at once; a writer that dies before that leaves nothing to see.  Commits
are numbered; a deleted key hides rows of earlier commits only, so an id can be registered again.
``compact`` rewrites what is alive into one commit.  Lookups are joins of these tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.operators import classify, quality, stats
from tabsight.operators import evidence as EV
from tabsight.operators.models import save_model
from tabsight.operators.ordered import checked_broadcast
from tabsight.session import cut_lineage

SCHEMAS = {
    "datasets": "id string, name string, file_path string, file_type string, size_bytes long, row_count long, "
                "col_count long, checksum string, created_at timestamp",
    "dataset_profiles": "id string, dataset_id string, column_types string, quality_alerts string, "
                        "candidate_targets string, inferred_problem_type string, created_at timestamp",
    "analysis_runs": "id string, dataset_id string, user_goal string, status string, problem_type string, "
                     "target_column string, time_column string, validation_strategy string, final_model_id string, "
                     "critic_findings_json string, created_at timestamp, completed_at timestamp",
    "experiments": "id string, analysis_id string, dataset_id string, model_name string, model_family string, "
                   "validation_strategy string, cv_folds int, train_time_sec double, cv_mean double, cv_std double, "
                   "feature_names array<string>, status string, created_at timestamp",
    "experiment_metrics": "id string, experiment_id string, analysis_id string, metric_name string, "
                          "metric_value double, split_type string, created_at timestamp",
    "models": "id string, experiment_id string, analysis_id string, name string, task_type string, is_best boolean, "
              "artifact_path string, feature_importance_json string, created_at timestamp",
    "reports": "id string, analysis_id string, title string, full_report_markdown string, "
               "business_insights_json string, created_at timestamp",
    "run_params": "analysis_id string, experiment_id string, param string, value string",
}
# A model's id is its experiment's id with this ending.
MODEL_SUFFIX = ":model"


def model_id(experiment_id: str) -> str:
    return experiment_id + MODEL_SUFFIX


DELETED = "key string, value string"
# What goes with a deleted row: table and the column that names the deleted id.
CASCADE = {
    "datasets": [("dataset_profiles", "dataset_id"), ("analysis_runs", "dataset_id"), ("experiments", "dataset_id")],
    "analysis_runs": [("experiments", "analysis_id"), ("experiment_metrics", "analysis_id"), ("models", "analysis_id"),
                      ("reports", "analysis_id"), ("run_params", "analysis_id")],
}


class Commit:
    """Rows and deleted keys of several tables that become visible together."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.id = catalog, uuid.uuid4().hex
        self.added: list[str] = []
        self.deleted: list[str] = []
        self.replaced: list[str] = []
        self.empty: list[str] = []  # written, but without rows: no part of the commit
        self.keys: dict[str, str] = {}  # the key by which each deleted part names rows

    def _write(self, df: DataFrame, kind: str, name: str, written: list[str]) -> None:
        part = f"{kind}/{name}/commit={self.id}/part={len(written) + len(self.empty)}"
        df.write.parquet(self.catalog.path(part))
        written.append(part)

    def append(self, name: str, df: DataFrame) -> None:
        self._write(df.select(*columns(name)), "rows", name, self.added)

    def delete(self, name: str, ids: DataFrame, key: str = "id") -> None:
        """Deletes the rows that are visible now and whose ``key`` is among ``ids`` (a column of that name), and what hangs on them."""
        gone = cut_lineage(ids.select(F.col(key).cast("string").alias("value")).where("value is not null").distinct())
        self._forget(name, key, gone)

    def _forget(self, name: str, key: str, gone: DataFrame) -> None:
        below = CASCADE.get(name, [])
        if below and key != "id":  # the ids behind another key
            gone_ids = cut_lineage(self.catalog.read(name).join(gone.withColumnRenamed("value", key), key, "left_semi").select(F.col("id").alias("value")))
        else:
            gone_ids = gone
        for child, child_key in below:
            self._forget(child, child_key, gone_ids)
        self._write(gone.select(F.lit(key).alias("key"), "value"), "deleted", name, self.deleted)
        self.keys[self.deleted[-1]] = key

    def __enter__(self) -> Commit:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.catalog._publish(self)


def columns(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # commits

    def commit(self) -> Commit:
        return Commit(self)

    def manifests(self) -> list[dict]:
        """What every commit has added, deleted and replaced, in order; ``compact`` keeps their number small."""
        folder = self._Path(self.path("_commits"))
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        names = sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))
        if not names:
            return []
        texts = self.spark.read.text([self.path(f"_commits/{n}") for n in names], wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("n"), "value")
        return [{"seq": int(r["n"].split(".")[0]), **json.loads(r["value"])} for r in sorted(texts.collect(), key=lambda r: r["n"])]

    def _publish(self, commit: Commit) -> None:
        """Writes the manifest beside its place and renames it there: the one step that makes the commit visible."""
        folder = self._Path(self.path("_commits"))
        self._fs.mkdirs(folder)
        text = json.dumps({"commit": commit.id, "added": commit.added, "deleted": commit.deleted, "replaced": commit.replaced, "keys": commit.keys})
        draft = self._Path(self.path(f"_commits/_{commit.id}"))
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        seq = max([int(x.getPath().getName().split(".")[0]) for x in self._fs.listStatus(folder) if x.getPath().getName().endswith(".json") and x.getPath().getName()[0].isdigit()], default=0)
        while True:  # another writer may have taken the number
            seq += 1
            place = self._Path(self.path(f"_commits/{seq:012d}.json"))
            if not self._fs.exists(place) and self._fs.rename(draft, place):
                return

    def _parts(self, manifests: list[dict], kind: str, name: str) -> list[tuple[str, int]]:
        """Folders of the visible commits, with the commit's number."""
        replaced = {p for m in manifests for p in m["replaced"]}
        return [(p, m["seq"]) for m in manifests for p in m[{"rows": "added", "deleted": "deleted"}[kind]] if p.startswith(f"{kind}/{name}/") and p not in replaced]

    def _numbered(self, parts: list[tuple[str, int]], kind: str, name: str, schema: str) -> DataFrame:
        """Rows of ``parts``, with the commit's number."""
        if not parts:
            return self.spark.createDataFrame([], schema + ", _seq long")
        base = self.path(f"{kind}/{name}")
        numbers = self.spark.createDataFrame([(p.split("commit=")[1].split("/")[0], n) for p, n in dict(parts).items()], "_commit string, _seq long").distinct()
        rows = self.spark.read.schema(f"{schema}, commit string, part int").option("basePath", base).parquet(*[self.path(p) for p, _ in parts])
        return rows.withColumnRenamed("commit", "_commit").drop("part").join(F.broadcast(numbers), "_commit").drop("_commit")

    def read(self, name: str, among: DataFrame | None = None) -> DataFrame:
        """Rows of a table that aren't deleted; of them those that meet ``among`` (one column, named as theirs)."""
        return self._alive(self.manifests(), name, among).select(*columns(name))

    def _alive(self, manifests: list[dict], name: str, among: DataFrame | None = None) -> DataFrame:
        """Only keys by which rows were deleted are joined, so that rows aren't shuffled by the others."""
        rows = self._numbered(self._parts(manifests, "rows", name), "rows", name, SCHEMAS[name])
        if among is not None:
            rows = rows.join(among, among.columns, "left_semi")
        by = {p: k for m in manifests for p, k in m.get("keys", {}).items()}
        deleted = self._parts(manifests, "deleted", name)
        for key in ("dataset_id", "id", "analysis_id"):
            own = [(p, n) for p, n in deleted if by.get(p, key) == key]  # a part whose key isn't known may hold any
            if key in rows.columns and own:
                gone = self._numbered(own, "deleted", name, DELETED)
                last = gone.where(F.col("key") == key).groupBy(F.col("value").alias(key)).agg(F.max("_seq").alias("_gone"))
                rows = rows.join(last, key, "left").where(F.col("_gone").isNull() | (F.col("_seq") > F.col("_gone"))).drop("_gone")
        return rows

    def compact(self) -> None:
        """One commit with all rows that are alive, instead of those before it and their deleted keys."""
        before = self.manifests()
        with self.commit() as c:
            for name in SCHEMAS:
                if not self._parts(before, "rows", name):
                    continue
                c.append(name, self._alive(before, name))
                if self.spark.read.schema(SCHEMAS[name]).parquet(self.path(c.added[-1])).isEmpty():  # what was written tells it without another pass
                    c.empty.append(c.added.pop())
            c.replaced = [p for m in before for p in [*m["added"], *m["deleted"]]]

    def append(self, name: str, df: DataFrame) -> None:
        with self.commit() as c:
            c.append(name, df)

    # S9 / J4
    def register_datasets(self, manifest: DataFrame) -> DataFrame:
        """Append manifest rows whose checksum is not registered yet; returns the new rows."""
        new = EV.unseen_rows(manifest, self.read("datasets"), "checksum")
        new = new if "id" in new.columns else new.withColumn("id", F.expr("uuid()"))
        new = cut_lineage(new.withColumn("created_at", F.current_timestamp()))
        self.append("datasets", new)
        return new

    # S11 / S12 / S14
    def persist_run(self, result, dataset_id: str, goal: str, save_champion: bool = True) -> str:
        """Stores a run in one commit; the champion is saved below ``artifacts`` in the catalog and named by its model row."""
        with self.commit() as c:
            return self._persist(c, result, dataset_id, goal, save_champion)

    def _persist(self, c: Commit, result, dataset_id: str, goal: str, save_champion: bool) -> str:
        spark = self.spark
        aid = result.analysis_id
        now = F.current_timestamp()
        champ_id = f"{aid}:{result.champion}" if result.champion else None
        champ_model = model_id(champ_id) if champ_id else None
        findings = json.dumps([r.asDict(recursive=True) for r in result.findings.collect()]) \
            if result.champion else "[]"  # a handful of finding rows
        run = spark.createDataFrame([(aid, dataset_id, goal, "COMPLETED", result.task.get("problem_type"),
                                      result.task.get("target_column"), result.task.get("time_column"),
                                      result.extra.get("validation") or result.task.get("recommended_validation"), champ_model, findings)],
                                    "id string, dataset_id string, user_goal string, status string, problem_type string, "
                                    "target_column string, time_column string, validation_strategy string, "
                                    "final_model_id string, critic_findings_json string") \
            .withColumn("created_at", now).withColumn("completed_at", now)
        c.append("analysis_runs", run)
        if not result.champion:
            return aid
        ex = result.experiments.select(
            F.col("experiment_id").alias("id"), "analysis_id", F.lit(dataset_id).alias("dataset_id"), "model_name",
            "model_family", "validation_strategy", F.lit(result.extra.get("folds")).cast("int").alias("cv_folds"), "train_time_sec", "cv_mean", "cv_std",
            "feature_names", F.lit("COMPLETED").alias("status"), now.alias("created_at"))
        c.append("experiments", ex)
        train_long = result.experiments.select("experiment_id", "analysis_id", F.explode("train").alias("metric_name", "metric_value")) \
            .withColumn("split_type", F.lit("train"))
        test_long = result.holdout.select(F.lit(champ_id).alias("experiment_id"), F.lit(aid).alias("analysis_id"),
                                          "metric_name", "metric_value",
                                          F.when(F.col("cutoff") == "default_0.50", "test").otherwise("test_locked").alias("split_type"))
        cv_long = EV.flatten_metrics(result.experiments.select("experiment_id", "analysis_id", "cv_mean", "cv_std"),
                                     ["experiment_id", "analysis_id"], ["cv_mean", "cv_std"], "cv")
        metrics = train_long.unionByName(test_long).unionByName(cv_long) \
            .where(F.col("metric_value").isNotNull() & ~F.isnan("metric_value")) \
            .withColumn("id", F.expr("uuid()")).withColumn("created_at", now)
        c.append("experiment_metrics", metrics)
        # Parameters of every candidate (a few rows per model)
        prow = [(aid, f"{aid}:{e.name}", k, str(v)) for e in result.extra.get("experiments", [])
                for k, v in {**e.params, "preset": e.preset, "family": e.family}.items()]
        if prow:
            c.append("run_params", spark.createDataFrame(prow, SCHEMAS["run_params"]))
        champion = next((e for e in result.extra.get("experiments", []) if e.name == result.champion), None)
        artifact = f"{self.root}/artifacts/{aid}" if save_champion and champion is not None else None
        if artifact:
            save_model(champion, artifact)
        imp = json.dumps([r.asDict() for r in result.importance.collect()]) if result.importance is not None else "[]"
        models = result.experiments.select(
            F.concat(F.col("experiment_id"), F.lit(MODEL_SUFFIX)).alias("id"), "experiment_id", "analysis_id",
            F.col("model_name").alias("name"), F.col("problem_type").alias("task_type"),
            (F.col("experiment_id") == F.lit(champ_id)).alias("is_best"), F.when(F.col("experiment_id") == F.lit(champ_id), F.lit(artifact)).cast("string").alias("artifact_path"),
            F.when(F.col("experiment_id") == F.lit(champ_id), F.lit(imp)).alias("feature_importance_json"),
            now.alias("created_at"))
        c.append("models", models)
        insights = [r.asDict(recursive=True) for r in result.insights.collect()]
        ins = json.dumps(insights)
        text = f"# Analysis {aid}\n\nChampion: {result.champion}\n\n" + "".join(
            "- " + " | ".join(str(v) for v in i.values() if v is not None) + "\n" for i in insights)
        c.append("reports", spark.createDataFrame([(str(uuid.uuid4()), aid, f"Analysis {aid}", text, ins)],
                                                     "id string, analysis_id string, title string, "
                                                     "full_report_markdown string, business_insights_json string")
                    .withColumn("created_at", now))
        return aid

    # S15
    def delete(self, name: str, ids: DataFrame, key: str = "id") -> None:
        """Deletes the rows whose ``key`` is among ``ids`` (a column of that name), and what hangs on them, in one commit."""
        with self.commit() as c:
            c.delete(name, ids, key)

    # A19
    def counts(self) -> DataFrame:
        parts = [self.read(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
                 for n in ("datasets", "analysis_runs", "experiments", "models")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # J1
    def datasets_with_profile(self) -> DataFrame:
        return self.read("datasets").alias("d").join(
            self.read("dataset_profiles").alias("p"), F.col("d.id") == F.col("p.dataset_id"), "left")

    def register_profile(self, dataset_id: str, df: DataFrame, target: str | None = None) -> DataFrame:
        """Profile row of a registered dataset (column types, alerts, candidate targets, previewed task)."""
        cs = cut_lineage(stats.column_stats(df))
        types = cs.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("column", "semantic_type")))).alias("column_types"))
        alerts = quality.quality_alerts(df, target, cs).agg(F.to_json(F.collect_list(F.struct("*"))).alias("quality_alerts"))
        seen = classify.profile_preview(df, cs).select(F.to_json("candidate_targets").alias("candidate_targets"), "inferred_problem_type")
        row = types.crossJoin(alerts).crossJoin(seen).select(  # one row each
            F.expr("uuid()").alias("id"), F.lit(dataset_id).alias("dataset_id"), "*", F.current_timestamp().alias("created_at"))
        row = cut_lineage(row)
        self.append("dataset_profiles", row)
        return row

    # J5
    def dashboard(self) -> DataFrame:
        """Latest completed run of each dataset with its champion model; without any such run, the best models, the latest of each
        dataset."""
        names = self.read("datasets").select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
        models = self.read("models")
        label = F.coalesce("dataset_name", "dataset_id", "model_name").alias("label")
        runs = self.read("analysis_runs").where(F.col("status") == "COMPLETED").withColumn("label_key", F.coalesce("dataset_id", "id"))
        latest = EV.latest_per_key(runs, "label_key", ["created_at", "id"], "_ds")
        champions = latest.select("dataset_id", "problem_type", "final_model_id").join(
            models.select(F.col("id").alias("final_model_id"), F.col("name").alias("model_name"), "analysis_id"), "final_model_id")
        rows = champions.join(names, "dataset_id", "left").select(label, "dataset_id", "model_name", "problem_type", "analysis_id")
        if not rows.isEmpty():
            return rows
        of_run = self.read("analysis_runs").select(F.col("id").alias("analysis_id"), "dataset_id")
        best = models.where("is_best").join(of_run, "analysis_id", "left").join(names, "dataset_id", "left") \
            .withColumn("model_name", F.col("name")).withColumn("label", F.coalesce("dataset_name", "dataset_id", "model_name"))
        return EV.latest_per_key(best, "label", ["created_at", "id"], "_l").select(
            "label", "dataset_id", "model_name", F.col("task_type").alias("problem_type"), "analysis_id")

    # P7, W6, K5
    def models_page(self, is_best: bool | None = None, task_type: str | None = None, latest_per_dataset: bool = False,
                    offset: int = 0, limit: int = 100) -> DataFrame:
        """Models with the name of their dataset, latest first; of one state or task, or the latest of each dataset only.

        A dataset is known by the experiment's dataset id, else by its name, else the model stands for itself."""
        m = self.read("models")
        if is_best is not None:
            m = m.where(F.col("is_best") == is_best)
        if task_type:
            m = m.where(F.col("task_type") == task_type)
        ex = self.read("experiments").select(F.col("id").alias("experiment_id"), "dataset_id")
        ds = self.read("datasets").select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
        m = m.join(ex, "experiment_id", "left").join(ds, "dataset_id", "left")
        if latest_per_dataset:
            m = EV.latest_per_key(m.withColumn("_key", F.coalesce("dataset_id", "dataset_name", "name")), "_key", ["created_at", "id"], "_k").drop("_k")
        return EV.paginate(m.select("id", "name", "task_type", "is_best", "dataset_id", "dataset_name", "created_at"), [F.col("created_at").desc(), F.col("id").desc()], offset, limit)

    # W7 + J2 / Z4
    def evidence(self, dataset_id: str | None = None, analysis_id: str | None = None, report_id: str | None = None,
                 comparison_id: str | None = None) -> DataFrame:
        """One wide row per run: run, dataset name, champion experiment, its metrics (map per split), its drivers and locked
        threshold, the critic's findings, the experiment list and, for ``comparison_id``, what is known of that run.

        The most specific id that leads to a run wins: report, run, then the dataset's latest completed run.  Without any id,
        the latest completed run of every dataset."""
        every = self.read("analysis_runs")
        latest = EV.latest_per_key(every.where(F.col("status") == "COMPLETED").withColumn("_own", F.coalesce("dataset_id", "id")), "_own", ["created_at", "id"], "_ds").drop("_ds")
        ranked = []
        if report_id:
            of_report = self.read("reports").where(F.col("id") == report_id).select(F.col("analysis_id").alias("id"))
            ranked.append(every.join(of_report, "id", "left_semi"))
        if analysis_id:
            ranked.append(every.where(F.col("id") == analysis_id))
        if dataset_id:
            ranked.append(latest.where(F.col("dataset_id") == dataset_id).select(*every.columns))
        runs = next((r for r in ranked if not r.isEmpty()), ranked[-1]) if ranked else latest.select(*every.columns)
        runs = cut_lineage(runs)  # a run a dataset; only what belongs to these runs is read of the other tables
        compared = every.where(F.col("id") == comparison_id) if comparison_id else runs.limit(0)
        compared = cut_lineage(compared)
        run_ids = checked_broadcast(runs.select(F.col("id").alias("analysis_id")).distinct())
        champions = runs.select("final_model_id").unionByName(compared.select("final_model_id")).distinct()
        model_ids = checked_broadcast(champions.select(F.col("final_model_id").alias("id")))
        experiment_ids = checked_broadcast(champions.where(F.col("final_model_id").endswith(MODEL_SUFFIX)).select(
            F.expr(f"left(final_model_id, length(final_model_id) - {len(MODEL_SUFFIX)})").alias("experiment_id")))
        ds = self.read("datasets").select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
        ex = self.read("experiments", run_ids).groupBy("analysis_id").agg(F.collect_list(F.struct(
            "model_name", "model_family", "cv_mean", "cv_std")).alias("experiments"))
        mt = self.read("experiment_metrics", experiment_ids)
        champ_metrics = mt.groupBy("experiment_id", "split_type").agg(
            F.map_from_entries(F.collect_list(F.struct("metric_name", "metric_value"))).alias("m")) \
            .groupBy("experiment_id").agg(F.map_from_entries(F.collect_list(F.struct("split_type", "m"))).alias("champion_metrics"))
        drivers = self.read("models", model_ids).select(F.col("id").alias("final_model_id"), F.col("feature_importance_json").alias("drivers_json"), "artifact_path")
        locked = mt.where("split_type = 'test_locked' and metric_name = 'threshold'").groupBy("experiment_id").agg(F.max("metric_value").alias("locked_threshold"))
        champ_metrics = champ_metrics.join(locked, "experiment_id", "left")
        runs = runs.join(drivers, "final_model_id", "left")
        champ_metrics = champ_metrics.withColumn("final_model_id", F.concat("experiment_id", F.lit(MODEL_SUFFIX)))
        out = runs.join(ds, "dataset_id", "left").join(ex, runs.id == ex.analysis_id, "left").drop(ex.analysis_id).join(champ_metrics, "final_model_id", "left")
        if not comparison_id:
            return out
        other = compared.join(champ_metrics, "final_model_id", "left").select(F.struct(
            "id", "dataset_id", "problem_type", "target_column", "final_model_id", "champion_metrics").alias("comparison"))
        return out.join(other, F.lit(True), "left")  # at most one row
