"""Positions in groups without a group in one task, and hashes of ordered rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm._text import written


def positions(rows: DataFrame, key: str, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` dealt out by sampled ranges of (key, order) and written, with ``part``, the range, and ``at``, the place
    in it; and one row per (key, part): ``first_at``, ``n`` and ``before``, the key's rows in earlier ranges.

    The position of a row under its key is ``at - first_at + before``. A key of very many rows is cut into ranges, and its
    window of earlier ranges has one row per range; rows that agree in all of ``order`` are told apart by their place of origin.
    """
    dealt = rows.withColumn("_origin", F.monotonically_increasing_id()).repartitionByRange(F.col(key).asc_nulls_first(), *order, "_origin")
    placed = dealt.sortWithinPartitions(F.col(key).asc_nulls_first(), *order, "_origin").drop("_origin").withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed, name).withColumns({"part": F.shiftright("_id", 33).cast("int"), "at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    parts = placed.groupBy(key, "part").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _digests(batches: Iterator[pa.RecordBatch], joint: bytes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, state, first = None, None, True
    keys: list = []
    out: list[str] = []
    for b in batches:
        for key, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if state is None or key != held:
                if state is not None:
                    keys.append(held)
                    out.append(state.hexdigest())
                held, state, first = key, hashlib.sha256(), True
            if not first:
                state.update(joint)
            first = False
            state.update(memoryview(piece.as_buffer()))
        if keys:
            yield pa.record_batch([pa.array(keys, schema.field(0).type), pa.array(out, pa.string())], schema=schema)
            keys, out = [], []
    if state is not None:
        yield pa.record_batch([pa.array([held], schema.field(0).type), pa.array([state.hexdigest()], pa.string())], schema=schema)


def sha256_in_order(rows: DataFrame, key: str, order: str, piece: str, joint: str) -> DataFrame:
    """(key, sha256): SHA-256 of each key's pieces in order, joined by ``joint``.

    A hash is sequential, so a key's pieces pass through one task; they are sorted outside of memory and read one by one.
    """
    kind = dict(rows.dtypes)[key]
    schema = pa.schema([(key, pa.int64() if kind == "bigint" else pa.string()), ("sha256", pa.string())])
    sent = joint.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digests(batches, sent, schema)
    own = rows.repartition(F.col(key)).sortWithinPartitions(key, order)
    return own.select(key, F.col(piece).cast("binary").alias("piece")).mapInArrow(run, f"{key} {kind}, sha256 string")
