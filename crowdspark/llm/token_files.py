"""Token-ID files: flat unsigned integers and 64-bit document offsets, read back memory-mapped."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, local_path, slices
from .words import encoder

_WRITTEN = "part int, name string, width int, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 2) -> list[dict]:
    """Encode ``docs(doc_id, text)`` into files under ``out`` in ascending doc_id order; the list of files.

    Each range of doc_ids is one pair of files. ``part-N.bin`` has the ids one after the other as little-endian
    unsigned 16-bit integers (32-bit if the vocabulary needs it). ``part-N.idx`` has, as little-endian 64-bit
    integers, the number of documents n, n+1 offsets into the ids, the n doc_ids, and n flags that are 1 where
    the doc_id was null. A file's ``base`` is the number of ids in all files before it, a prefix sum over the
    list (one entry a file). Null text counts as empty; a null doc_id comes first; rows that share a doc_id are
    ordered by a hash of their text, then by text, so many of them (or of null) fill several ranges; an empty table gives no file; other columns are ignored. A retried task writes the same
    bytes under the same name.
    """
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    ordered = named.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")

    def write(batches):
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        fs, folder = filesystem(out)
        fs.create_dir(folder, recursive=True)
        name = f"part-{part:06d}"
        own = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        end = np.array([] if end_id is None else [end_id], coder.dtype)
        lengths, ids_seen = [], []
        with fs.open_output_stream(f"{own}.bin") as stream:
            for batch in batches:
                for piece in slices(batch, "text"):
                    ids, offsets = coder.encode(piece.column("text"))
                    ids = np.insert(ids, np.repeat(offsets[1:], len(end)), np.tile(end, len(offsets) - 1)) if len(end) else ids
                    stream.write(ids.astype(np.dtype(coder.dtype).newbyteorder("<")).tobytes())
                    lengths.append(np.diff(offsets) + len(end))
                    ids_seen.append(piece.column("doc_id"))
        if not lengths:
            fs.delete_file(f"{own}.bin")
            return
        length = np.concatenate(lengths)
        keys = pa.chunked_array(ids_seen)
        index = np.concatenate([[len(length), 0], np.cumsum(length), keys.fill_null(0).to_numpy(), keys.is_null().to_numpy().astype(np.int64)])
        with fs.open_output_stream(f"{own}.idx") as stream:
            stream.write(index.astype("<i8").tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{own}.{kind}", f"{folder}/{name}.{kind}")
        row = {"part": part, "name": name, "width": np.dtype(coder.dtype).itemsize, "n_docs": len(length), "n_tokens": int(length.sum())}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    files = [r.asDict() for r in ordered.mapInArrow(write, _WRITTEN).collect()]  # one short row a file
    files.sort(key=lambda f: f["part"])
    bases = itertools.accumulate((f["n_tokens"] for f in files), initial=0)
    return [f | {"base": base} for f, base in zip(files, bases)]


def open_token_file(out: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Memory-mapped ids, offsets, doc_ids and null flags of one file."""
    index = np.memmap(local_path(f"{out}/{name}.idx"), "<i8", "r")
    n = int(index[0])
    path = local_path(f"{out}/{name}.bin")
    ids = np.memmap(path, f"<u{width}", "r") if index[n + 1] else np.zeros(0, f"<u{width}")
    return ids, index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :]


def read_token_files(spark, out: str, files: list[dict]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, file. Each task maps whole files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["part"], f["name"], f["width"], f["base"]) for f in files], "part int, name string, width int, base long")
    listed = listed.repartitionByRange(len(files), "part")

    def read(batches):
        for batch in batches:
            for f in batch.to_pylist():
                ids, offsets, keys, null = open_token_file(out, f["name"], f["width"])
                for at in range(0, len(keys), 10_000):
                    to = min(at + 10_000, len(keys))
                    bounds = offsets[at : to + 1]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in itertools.pairwise(bounds.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(keys[at:to]), mask=np.array(null[at:to], bool)), pa.array(bounds[:-1] + f["base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array([f["name"]] * (to - at))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                    )

    return listed.mapInArrow(read, schema).withColumn("file", F.concat(F.col("file"), F.lit(".bin")))
