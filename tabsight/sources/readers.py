"""Dataset sources (S1-S8, S10): format dispatch, delimiter inference, manifests, previews, sinks."""

from __future__ import annotations

import hashlib
import os
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabsight.sources import files

# Supported extensions and delimiter candidates (in preference order).
FORMATS = {".csv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json"}
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_LINES, SNIFF_BYTES = 20, 16384
#: Bytes of a file that are in memory while it is hashed.
PIECE_BYTES = 1 << 22
#: Largest file that is read as one cell where tasks can't open files.
CELL_BYTES = 1 << 27
PREVIEW_MAX = 500


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (or the file itself), through the file system that Spark uses for the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def format_of(path: str, spark: SparkSession | None = None) -> str:
    """Reader format from the file's extension, or for a folder from its data files' extensions."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    spark = spark or SparkSession.getActiveSession()
    if not ext and spark is not None:
        exts = [os.path.splitext(f)[1].lower() for f in sorted(_listed(spark, path)) if not f.startswith(("_", "."))]
        ext = next((e for e in exts if e in FORMATS), "")
    if ext not in FORMATS:
        raise ValueError(f"Unsupported file format '{ext or path}'. Supported: {', '.join(sorted(FORMATS))}")
    return FORMATS[ext]


def _lines(head: bytes, cut: bool, most: int) -> list[str]:
    """The first lines of a file's head; if the file goes on, what may be half a line is left out."""
    lines = head.decode("utf-8-sig", errors="replace").splitlines()
    return (lines[:-1] if cut and len(lines) > 1 else lines)[:most]


def file_heads(spark: SparkSession, path: str, lines: int = SNIFF_LINES, n_bytes: int = SNIFF_BYTES) -> DataFrame:
    """(path, lines): the first lines of each file's first ``n_bytes`` bytes, decompressed by its extension.

    Spark lists the files; tasks open each of them and read its head only, whatever its size. File systems that only Spark
    reaches are read through its text source."""
    listed = list_files(spark, path)
    if not files.reachable(listed):
        txt = spark.read.text(path).select(F.input_file_name().alias("path"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
        first = txt.where("block = 0").withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).where(F.col("n") <= lines)
        return first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("lines"))

    def head(f, size: int) -> list[str]:
        got = f.read(n_bytes)
        return _lines(got, len(got) == n_bytes, lines)
    return files.read_each(listed.select("path", "size_bytes").repartition("path"), head, "lines", "array<string>")


def detect_delimiters(spark: SparkSession, path: str, lines: int = SNIFF_LINES, n_bytes: int = SNIFF_BYTES) -> DataFrame:
    """(path, delimiter) per text file from the first lines of its head.

    A candidate whose per-line count is constant and non-zero beats one whose count varies; then the larger mean count
    wins; remaining ties follow the candidate order.  All files are scored in one job."""
    heads = file_heads(spark, path, lines, n_bytes)
    cands = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)])
    scored = F.transform(cands, lambda c: F.struct(
        F.transform("lines", lambda x: F.length(x) - F.length(F.replace(x, c["delimiter"], F.lit("")))).alias("n"), c["rank"].alias("rank"), c["delimiter"].alias("delimiter")))
    mean = lambda c: F.aggregate(c["n"], F.lit(0), lambda a, b: a + b) / F.greatest(F.size(c["n"]), F.lit(1))
    keys = F.transform(scored, lambda c: F.struct(
        (F.array_min(c["n"]).eqNullSafe(F.array_max(c["n"])) & (F.coalesce(F.array_min(c["n"]), F.lit(0)) > 0)).alias("constant"),
        mean(c).alias("mean"), (-c["rank"]).alias("rank"), c["delimiter"].alias("delimiter")))
    best = F.array_max(keys)
    return heads.select("path", F.when(best["mean"] > 0, best["delimiter"]).otherwise(F.lit(",")).alias("delimiter"))


def load_dataset(spark: SparkSession, path: str, delimiter: str | None = None, infer_schema: bool = True,
                 fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """Read one dataset by extension (or ``fmt``); CSV with header, UTF-8, inferred types,
    malformed rows dropped.  JSON holds one object per line; ``multi_line`` reads files that are one JSON
    value each (not splittable).  Files of a folder that differ in delimiter are read apart and put together
    by column name.  NaN is left to the operators, so that filters reach the scan."""
    fmt = fmt or format_of(path, spark)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        return spark.read.option("multiLine", multi_line).json(path)

    def csv(paths, sep: str) -> DataFrame:
        return (spark.read.option("header", True).option("inferSchema", infer_schema).option("sep", sep)
                .option("encoding", "UTF-8").option("mode", "DROPMALFORMED").csv(paths))
    if delimiter:
        return csv(path, delimiter)
    found = detect_delimiters(spark, path)
    kinds = [r["delimiter"] for r in found.select("delimiter").distinct().orderBy("delimiter").collect()]  # at most four
    if len(kinds) <= 1:
        return csv(path, kinds[0] if kinds else ",")
    parts = [csv([r["path"] for r in found.where(F.col("delimiter") == k).select("path").collect()], k) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, modificationTime of the files below ``path``, as Spark lists them (empty files are left out); no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size_bytes"), "modificationTime")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, name, size, modification time, sha256 of the content."""
    return manifest_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content"))


def manifest_of(found: DataFrame) -> DataFrame:
    """The manifest of files as the binary source lists them (path, modificationTime, length; content is not needed).

    A task streams each of its files through the digest in pieces, so size doesn't matter, and no content becomes a cell.
    In file systems that only Spark reaches, files up to ``CELL_BYTES`` are read as binary cells, and the driver streams larger ones
    through the digest."""
    listed = found.select("path", F.col("length").alias("size_bytes"), "modificationTime")
    if files.reachable(listed):
        spread = listed.select("path", "size_bytes").repartitionByRange(F.col("size_bytes").desc(), "path")
        sums = files.read_each(spread, _sha256, "checksum", "string", compression=None)
    else:
        sums = _sums_through_spark(found.sparkSession, listed.select("path", "size_bytes").collect())  # one row per file
    return listed.join(sums, "path").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes", "modificationTime", "checksum")


def _sums_through_spark(spark: SparkSession, listed: list) -> DataFrame:
    """(path, checksum) of files that only Spark's own file systems open."""
    most = min(CELL_BYTES, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    small = [r["path"] for r in listed if r["size_bytes"] <= most]
    large = [r["path"] for r in listed if r["size_bytes"] > most]
    with ThreadPoolExecutor(max_workers=4) as ex:
        sums = spark.createDataFrame(list(ex.map(lambda p: (p, _sha256_through_spark(spark, p)), large)), "path string, checksum string")
    if small:
        # names may hold what a pattern is made of
        named = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in small]
        sums = sums.unionByName(spark.read.format("binaryFile").load(named).select("path", F.sha2("content", 256).alias("checksum")))
    return sums


def _sha256_through_spark(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    f = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(f)
    finally:
        f.close()


def _sha256(f, size: int) -> str:
    digest = hashlib.sha256()
    while piece := f.read(PIECE_BYTES):
        digest.update(piece)
    return digest.hexdigest()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint of any table: row count and the sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def dataset_metadata(df: DataFrame, name: str, file_type: str) -> DataFrame:
    """S7 (table part): name, type, row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("name"), F.lit(file_type).alias("file_type"), "row_count",
        F.lit(len(df.columns)).cast("long").alias("col_count"))


def preview(df: DataFrame, n: int = 50, order_by: list[str] | None = None) -> DataFrame:
    """First n rows (1..500) as text, missing values shown as ''."""
    n = max(1, min(int(n), PREVIEW_MAX))
    d = df.orderBy(*order_by) if order_by else df
    return d.limit(n).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """CSV sink with header."""
    df.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)
