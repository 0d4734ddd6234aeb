import gzip
import hashlib
import os

import pytest

from tabsight.sources import files
from tabsight.sources import readers as R


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in put"
    d.mkdir()
    (d / "a.csv").write_text("x;y\n1;2,5\n3;4,5\n")
    (d / "b.txt").write_text("x\ty\n1\t2\n")
    (d / "c.csv").write_text("x|y|z\n" + "1|2,2|3\n" * 100_000)
    (d / "d.csv").write_text("one\n1\n")
    (d / "e.csv").write_bytes(b"")
    (d / "f.csv").write_text("x,y\n1,2")
    with gzip.open(d / "g.csv.gz", "wt") as f:
        f.write("x;y\n1;2\n")
    return str(d)


def test_delimiters_of_all_files_from_their_heads(spark, folder):
    got = {os.path.basename(r["path"]): r["delimiter"] for r in R.detect_delimiters(spark, folder).collect()}
    assert got == {"a.csv": ";", "b.txt": "\t", "c.csv": "|", "d.csv": ",", "f.csv": ",", "g.csv.gz": ";"}
    heads = {os.path.basename(r["path"]): r["lines"] for r in R.file_heads(spark, folder, n_bytes=20).collect()}
    assert heads["c.csv"] == ["x|y|z", "1|2,2|3"] and heads["f.csv"] == ["x,y", "1,2"] and "e.csv" not in heads  # empty files are not listed


def test_only_the_head_is_read(spark, tmp_path, monkeypatch):
    """The bytes read do not grow with the file."""
    asked = []

    class Stream:
        def read(self, n):
            asked.append(n)
            return b"x,y\n" * (n // 4)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

    class System:
        def open_input_stream(self, path, compression):
            return Stream()
    import pandas as pd
    sent = {}

    class Listed:
        def mapInPandas(self, run, schema):
            sent["run"] = run
    monkeypatch.setattr(files, "opened", lambda path: (System(), path))
    files.read_each(Listed(), lambda f, size: R._lines(f.read(R.SNIFF_BYTES), True, 20), "lines", "array<string>")
    out = next(iter(sent["run"]([pd.DataFrame({"path": ["p"], "size_bytes": [10**13]})])))
    assert asked == [16384] and len(out["lines"][0]) == 20


def test_checksums_stream_the_content(spark, folder, monkeypatch):
    want = {n: (os.path.getsize(os.path.join(folder, n)), hashlib.sha256(open(os.path.join(folder, n), "rb").read()).hexdigest()) for n in os.listdir(folder) if n != "e.csv"}
    assert {r["name"]: (r["size_bytes"], r["checksum"]) for r in R.file_manifest(spark, folder).collect()} == want
    monkeypatch.setattr(files, "reachable", lambda listed: False)  # a store that only Spark reads
    assert {r["name"]: (r["size_bytes"], r["checksum"]) for r in R.file_manifest(spark, folder).collect()} == want


def test_a_store_that_only_spark_reads_gives_the_same_delimiters(spark, folder, monkeypatch):
    found = {r["path"].split("/")[-1]: r["delimiter"] for r in R.detect_delimiters(spark, folder).collect()}
    monkeypatch.setattr(files, "reachable", lambda listed: False)
    other = {r["path"].split("/")[-1]: r["delimiter"] for r in R.detect_delimiters(spark, folder).collect()}
    assert {k: other.get(k, ",") for k in found} == found


@pytest.mark.parametrize("reachable", [True, False])
def test_files_larger_than_a_cell_are_registered(spark, tmp_path, monkeypatch, reachable):
    """No content becomes a cell; where only Spark opens files, large ones are streamed and small ones are cells."""
    from tabsight.streaming import ingest
    landing = tmp_path / "land ing"
    landing.mkdir()
    for name, n in (("large", 20_000), ("small", 3)):
        spark.range(n).toPandas().to_parquet(landing / f"{name}.parquet")
    real = files.reachable
    monkeypatch.setattr(files, "reachable", lambda listed: reachable and real(listed))
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, (landing / "large.parquet").stat().st_size - 1)
    try:
        ingest.start_registration(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "stream")).awaitTermination()
    finally:
        spark.conf.unset(limit)
    got = {r["name"]: (r["checksum"], r["row_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    digest = {n: hashlib.sha256((landing / f"{n}.parquet").read_bytes()).hexdigest() for n in ("large", "small")}
    assert got == {"large": (digest["large"], 20_000), "small": (digest["small"], 3)}


def test_paths_of_file_systems():
    assert files.opened("file:/a b/c#1.csv")[1] == "/a b/c#1.csv"
    assert files.opened("file:///a/c.csv")[1] == "/a/c.csv" and files.opened("/a/c.csv")[1] == "/a/c.csv"


def test_pieces():
    class Stream:
        def __init__(self):
            self.left, self.most = 3 * R.PIECE_BYTES + 7, 0

        def read(self, n):
            self.most = max(self.most, n)
            n = min(n, self.left)
            self.left -= n
            return b"z" * n
    s = Stream()
    assert R._sha256(s, 0) == hashlib.sha256(b"z" * (3 * R.PIECE_BYTES + 7)).hexdigest() and s.most == R.PIECE_BYTES
