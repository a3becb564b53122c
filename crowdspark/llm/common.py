"""Helpers shared by the corpus operators: inputs, the shared run folder, files in it."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as Java and RE2 regular expressions write it.
SPACE_CLASS = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Where that is unset, a fresh one on a single machine; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; one for each call, so runs never see each other's files."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage in files that outlive executors."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a URI, as Hadoop writes it too: ``file:/x``, ``s3a://`` and ``s3n://``."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest)


def write_atomic(uri: str, chunks) -> None:
    """Write byte chunks under a temporary name and rename, so that a retried task replaces whole files only."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(temporary, path)


class _Fetched(dict):
    """Local copies of remote files, by URI; the oldest go beyond ``limit`` bytes (what is mapped from them stays mapped)."""

    limit = 2 << 30

    def add(self, uri: str, path: str) -> None:
        self[uri] = path
        while len(self) > 1 and sum(os.path.getsize(p) for p in self.values()) > self.limit:
            os.unlink(self.pop(next(iter(self))))


_fetched = _Fetched()


def local_path(uri: str) -> str | None:
    """A path that can be memory-mapped: the file itself on a mounted folder, else a copy fetched by the worker; None if there is no such file."""
    if uri in _fetched:
        return _fetched[uri]
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        return path
    target = os.path.join(tempfile.mkdtemp(prefix="fetched-"), os.path.basename(path))
    with fs.open_input_stream(path) as source, open(target, "wb") as out:
        while block := source.read(1 << 24):
            out.write(block)
    _fetched.add(uri, target)
    return target


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_bucket(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; 0 where the id is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """Cut a batch into runs of rows whose texts take about ``most`` bytes together (one row at least)."""
    size = batch.column(column).fill_null("").cast(pa.large_string())
    ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset + 1 : size.offset + 1 + len(size)]
    base = np.frombuffer(size.buffers()[1], np.int64)[size.offset] if len(size) else 0
    at = 0
    while at < len(size):
        start = base if at == 0 else ends[at - 1]
        to = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
        yield batch.slice(at, to - at)
        at = to
