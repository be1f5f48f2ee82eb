"""Manifest of a mounted file tree: directories, files, links and modes, files of any size.

Folders are listed level by level; each level is a job whose tasks list the
folders that the level before found, so no process lists the whole tree.  Files
are then hashed in tasks of their own, ``BLOCK`` bytes at a time, so a file may
be larger than a task's memory.  Driver and executors must see the tree at the
same path (a mount, or a local session); object stores have no modes or links
and are read by :func:`fleetlens.sources.readers.file_manifest`.
"""

from __future__ import annotations

import hashlib
import os
import stat
import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.folders import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4 * 1024 * 1024
#: Bytes that one hashing task reads, about, and tasks at most.
TASK_BYTES = 256 * 1024 * 1024
TASKS = 100_000

_ENTRY = pa.schema([("path", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("mode", pa.int32()), ("mtime", pa.int64())])
_ENTRY_DDL = "path string, type string, size long, mode int, mtime long"


def _text(name: str) -> str:
    """A name that is no UTF-8 has its odd bytes escaped."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _kind(mode: int) -> str:
    return "directory" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "link" if stat.S_ISLNK(mode) else "other"


def _listing(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = []
                with os.scandir(os.path.join(root, folder)) as entries:
                    for entry in entries:
                        info = entry.stat(follow_symlinks=False)
                        kind = _kind(info.st_mode)
                        name = _text(entry.name)
                        found.append((f"{folder}/{name}" if folder else name, kind, info.st_size if kind == "file" else 0,
                                      stat.S_IMODE(info.st_mode), info.st_mtime_ns // 1_000_000_000))
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _ENTRY)], schema=_ENTRY)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _ENTRY)], schema=_ENTRY)

    return run


def digest_of(path: str) -> str:
    """SHA-256 of a regular file, which must not be a link, read block by block."""
    sha = hashlib.sha256()
    with os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
        while block := f.read(BLOCK):
            sha.update(block)
    return f"sha256:{sha.hexdigest()}"


def _hashing(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [digest_of(os.path.join(root, p)) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "digest"])

    return run


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (relative), ``type`` (directory, file, link, other), ``size``, ``mode``, ``mtime`` (whole seconds), ``digest``.

    Links are not followed; they and what is no regular file have no digest.
    ``root`` itself, which must be a folder and no link, is not listed.
    """
    root = root.removeprefix("file://")
    if "://" in root:
        raise ValueError("a file tree is read at a mounted path")
    if not stat.S_ISDIR(os.lstat(root).st_mode):
        raise ValueError("the root is no folder")
    width = spark.sparkContext.defaultParallelism
    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        level = checkpointed(folders.mapInArrow(_listing(root), _ENTRY_DDL))
        levels.append(level)
        folders = level.filter("type = 'directory'").select("path")
        n = folders.count()
        if not n:
            break
        folders = folders.repartition(max(1, min(n, 4 * width, TASKS)))
    entries = reduce(DataFrame.unionByName, levels)
    files = entries.filter("type = 'file'")
    count, total = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(count, max(width, total // TASK_BYTES), TASKS))
    hashed = files.repartition(tasks).mapInArrow(_hashing(root), f"{_ENTRY_DDL}, digest string")
    return hashed.unionByName(entries.filter("type <> 'file'").withColumn("digest", F.lit("")))
