"""Shared helpers: byte-level tokenising with numpy, batching, and tables written to the shared folder."""

from __future__ import annotations

import contextlib
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.session import checkpoint_dir

#: Bytes of text tokenised at a time; longer documents form a chunk of their own.
CHUNK_BYTES = 1 << 19
#: Spark's limit for the rows handed to Python in one go.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_BYTES = np.arange(256)
#: ``[^\x20\x09-\x0D]+``
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text; every byte of a non-ASCII character belongs to it
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: A-Z to a-z, other bytes unchanged
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x2545F4914F6CDD1D))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        grown[0] = 1
        _powers[name] = have = np.cumprod(grown)
    return have[:n]


class Chunk:
    """Some documents' bytes with the words in them.

    ``buf``: the documents' UTF-8 bytes, lower-cased, one line break before and after each;
    ``at``/``till``: where each document's bytes begin and end in ``buf``;
    ``start``/``end``: where each word begins and ends; ``ptr``: first word of each document (one more entry at the end).
    """

    def __init__(self, first: int, parts: list[bytes], is_word: np.ndarray | None):
        self.first, self.n = first, len(parts)
        self.raw = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", dtype=np.uint8)
        self.buf = LOWER[self.raw]
        lens = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.at = 1 + np.concatenate(([0], np.cumsum(lens + 1)[:-1])).astype(np.int64)
        self.till = self.at + lens
        if is_word is not None:
            mask = is_word[self.buf]
            edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
            self.start, self.end = edges[0::2], edges[1::2]
            self.ptr = np.searchsorted(self.start, np.append(self.at, len(self.raw)))

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word (a polynomial over its bytes, then mixed)."""
        n = len(self.buf)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUE[self.buf] * _power("up", _BASE, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _power("down", pow(_BASE, -1, 1 << 64), n)[self.start]
        return mix64(h + (self.end - self.start).astype(np.uint64))

    def chars(self, doc: int, offsets: np.ndarray) -> np.ndarray:
        """Code point offsets in document ``doc`` of byte positions of ``buf``."""
        lead = (self.raw[self.at[doc]:self.till[doc]] & 0xC0) != 0x80
        return np.concatenate(([0], np.cumsum(lead)))[offsets - self.at[doc]]


def chunks(texts: pa.Array, is_word: np.ndarray | None = None, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a batch of texts (null: empty) into chunks of about ``size`` bytes; no text is cut."""
    parts = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    first = 0
    while first < len(parts):
        last, held = first, 0
        while last < len(parts) and (last == first or held + len(parts[last]) <= size):
            held += len(parts[last])
            last += 1
        yield Chunk(first, parts[first:last], is_word)
        first = last


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit fingerprints of every ``k`` consecutive entries of ``h``; with fewer (but some), of all of them."""
    k = min(k, len(h))
    if k == 0:
        return h[:0]
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + h[i:len(h) - k + 1 + i]
    return mix64(out + _U(k))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0]-1, 0 .. counts[1]-1, and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark must not broadcast. Spark sizes a side by its files, and neither counts what an explode or
    Python makes of a row nor what columns compress to, so a side of any size can seem small enough for the driver."""
    return df.hint("merge")


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Queries run meanwhile hand rows to Python in Arrow batches of about ``size`` bytes (whole rows; Spark's own 10,000 rows
    are some 35 MB of texts, held several times over by the JVM and by each worker)."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def answers(replies: DataFrame, name: str) -> DataFrame:
    """Replies (block, bucket, reply) put together: one row per block, with the replies in order of their buckets."""
    own = F.array_sort(F.collect_list(F.struct("bucket", "reply")))
    return replies.groupBy("block").agg(F.transform(own, lambda x: x["reply"]).alias(name))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors (as ``--py-files`` would), once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tabsight-py-"), f"tabsight-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    sc.addPyFile(path)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def reuse(cache: dict, key, make):
    """Per-process memory of one value: what a worker builds from a broadcast, for its next batches."""
    if key not in cache:
        cache.clear()
        cache[key] = make()
    return cache[key]
