"""The pipeline's stages on a small table, each held against a plain version on its own input, and the driver entry."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsight.llm import mixing, neardup, quality
from tabsight.llm._text import BATCH_SETTING, crc_mod, shared_path, ship, written

from . import brute


@pytest.fixture(scope="module")
def stages(spark):
    """Folder and the rows after each stage; documents have a column whose name clashes with the operators' own."""
    ship(spark)
    draw = random.Random(11)
    bag = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(draw.choice(bag) for _ in range(n)) + "."
    items = [(i, prose(30)) for i in range(6)]
    rows = []
    for i in range(260):
        text = prose(draw.randint(20, 90))
        if i % 9 == 0:
            text = text.upper().replace(" ", "!! ")
        elif i % 17 == 0:
            text = text + " " + items[i % 6][1]
        elif i % 13 == 0:
            text += f' token = "{"".join(draw.choice("0123456789abcdef") for _ in range(40))}" end'
        elif i % 11 == 0 and i > 20:
            w = rows[i - 10][1].split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        rows.append((i, text, ["en", "de", None][i % 3], f"src{i % 12}", len(text), "mine"))
    rows += [(300, None, "en", "src1", None, "mine"), (301, "", "en", None, 0, None), (302, rows[5][1], "en", "src0", 1, "mine")]
    sf = shared_path(spark, "pipeline-test").removeprefix("file:")
    os.makedirs(sf)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, hits string"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(0, 260)], "doc_id bigint, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    out.append(sorted(docs.collect(), key=lambda r: r.doc_id))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        if name != "mixing":
            assert docs.columns == columns
        out.append(sorted(docs.collect(), key=lambda r: r.doc_id))
    return sf, out, items


def test_quality_stage(spark, stages):
    sf, (docs, kept, *_), _ = stages
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    want = {r.doc_id for r in quality.score(spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id bigint, text string"), model).where("score >= 0.3").collect()}
    assert {r.doc_id for r in kept} == want
    bad = {r.doc_id for r in docs if r.doc_id < 260 and r.doc_id % 9 == 0}
    assert len(want & bad) <= 2 and len(set(range(260)) - bad - want) <= 5


def test_stages_hand_few_texts_to_python_at_once(spark, stages, monkeypatch):
    """A stage's rows are computed when its caller writes them, so the limit holds beyond the call; ``run`` takes it back."""
    sf, *_ = stages
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    before = spark.conf.get(BATCH_SETTING)
    try:
        for _, stage in corpus_pipeline.STAGES[2:]:
            spark.conf.unset(BATCH_SETTING)
            stage(spark, docs, sf)
            seen.append(int(spark.conf.get(BATCH_SETTING)))
        assert max(seen) <= 1 << 22
        spark.conf.set(BATCH_SETTING, "7654321")
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixing", corpus_pipeline.mixture)])
        assert corpus_pipeline.run(spark, sf).count()
        assert spark.conf.get(BATCH_SETTING) in ("7654321", "7654321b")
    finally:
        spark.conf.set(BATCH_SETTING, before)


def test_near_duplicate_stage(stages):
    _, (_, docs, kept, *_), _ = stages
    found = brute.components([(r.doc_id, r.text) for r in docs], (80, 100))
    assert kept == [r for r in docs if found[r.doc_id][1] == r.doc_id]
    assert len(kept) < len(docs) - 5


def test_decontamination_stage(stages):
    _, (_, _, docs, kept, *_), items = stages
    found = brute.contamination([r.text for r in docs], items)
    assert kept == [r for r, (n, hit, _) in zip(docs, found, strict=True) if not hit or 20 * len(hit) < n]
    assert len(kept) < len(docs)


def test_secret_stage(stages):
    _, (_, _, _, docs, kept, _), _ = stages
    assert [r.doc_id for r in kept] == [r.doc_id for r in docs]
    changed = 0
    for a, b in zip(docs, kept, strict=True):
        assert not brute.secrets(b.text)
        assert b.n_chars == (None if b.text is None else len(b.text))
        if brute.secrets(a.text):
            changed += 1
            assert "[secret]" in b.text
        else:
            assert a.text == b.text
    assert changed


def test_mixing_stage(stages):
    _, (*_, docs, mixed), _ = stages

    def domain(s):
        n = s[3:] if s and s.startswith("src") else ""
        return "crawl" if n in ("", "0") else "web" if len(n) == 1 else "curated"
    plain = [(r.doc_id, domain(r.source), r.lang or "", r.source or "", len(brute.words(r.text))) for r in docs]
    want = brute.mixture(plain, mixing.TARGET_PERCENT, mixing.MAX_EPOCHS, mixing.SEED, (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {}))
    assert {r.doc_id: r.n_copies for r in mixed} == {k: n for k, n in want.items() if n}


def test_run_gives_the_last_stage(spark, stages):
    sf, out, _ = stages
    assert sorted(corpus_pipeline.run(spark, sf).select("doc_id", "n_copies").collect()) == sorted((r.doc_id, r.n_copies) for r in out[-1])


def test_stages_take_an_empty_table(spark, stages):
    sf = stages[0]
    none = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_queries_are_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert {"op1_decontamination", "op2_repeated_passages", "op4_url_filter", "op5_near_duplicates", "op10_mixing", "op11_html_extraction", "op12_prefix_trie", "op13_conversation_repair"} <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["quality_classifier", "near_duplicates", "mixing"])
def test_no_side_that_grows_with_the_input_is_broadcast(spark, stages, name, monkeypatch):
    """Sizes are estimated by files: an explode's rows and many leaves seem small enough for the driver."""
    sf, plans = stages[0], []

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (neardup, quality):
        monkeypatch.setattr(module, "written", lambda df, *more: written(plan(df), *more))
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    plan(dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))
    assert any("Join" in p for p in plans) and not [p for p in plans if "Broadcast" in p]
