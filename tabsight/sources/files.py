"""Reading files piece by piece in tasks: a listing of paths in, one value per file out.

Spark lists the files and deals out their paths; a task opens each file through Arrow's file systems (local and mounted
folders, S3, GCS, HDFS) and reads as much of it as it needs.  Nothing of a file becomes a cell of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark spells it, and the path in it."""
    parts = urlsplit(path.split("#")[0].split("?")[0]) if "://" in path else None
    if parts is None or parts.scheme == "file":
        local = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + local.lstrip("/") if path.startswith("file:") else local
    system, root = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}")
    rest = path.split("://", 1)[1][len(parts.netloc):]
    return system, root.rstrip("/") + rest


def reachable(listed: DataFrame) -> bool:
    """Whether tasks can open the listed files (judged by one of them; a folder has one file system)."""
    first = listed.select("path").first()
    if first is None:
        return True
    try:
        system, path = opened(first["path"])
        return system.get_file_info(path).type == fs.FileType.File
    except Exception:  # noqa: BLE001 - a scheme that Arrow doesn't know, or a store without its library
        return False


def read_each(listed: DataFrame, read: Callable, name: str, kind: str, compression: str | None = "detect") -> DataFrame:
    """(path, ``name``): ``read(stream, size)`` of each file of ``listed`` (path, size_bytes)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size in zip(b["path"], b["size_bytes"]):
                system, inside = opened(path)
                with system.open_input_stream(inside, compression=compression) as f:
                    yield pd.DataFrame({"path": [path], name: [read(f, size)]})
    return listed.mapInPandas(run, f"path string, {name} {kind}")
