"""Exact duplicates by content sort."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: What normalising deletes: space and the five ASCII controls 9 to 13.
SPACES = " \t\n\v\f\r"
#: Groups over edges of partitions that are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 500_000
_RUNS = "doc_id long, keep_id long, points long, group_size long, text_sha256 string, run long, head boolean, edge boolean"
_TYPES = [("doc_id", pa.int64()), ("keep_id", pa.int64()), ("points", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string()), ("run", pa.int64()), ("head", pa.bool_()), ("edge", pa.bool_())]


def exact_duplicates(docs: DataFrame, out: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are dealt out by sampled splitters over (first bytes and SHA-256 of the normalised text, longest
    original, doc_id) and sorted there, so that equal texts are neighbours and a large group is spread over as
    many partitions as it fills. Neighbours are compared in full; the first of a run is the one that stays. Runs
    at the edges of partitions are joined up by their SHA-256, two of them a partition at most. ``out`` gets the
    runs. Null text counts as empty, and all empty texts are one group; a null doc_id comes after all others; of
    rows that agree in text and doc_id one stays; other columns are ignored.
    """
    norm = F.translate(text_or_empty(), SPACES, "")
    rows = docs.select("doc_id", F.length(text_or_empty()).cast("long").alias("points"), norm.cast("binary").alias("norm"))
    rows = rows.select("*", F.substring("norm", 1, 32).alias("lead"), F.unhex(F.sha2("norm", 256)).alias("digest"))
    tail = [F.desc("points"), F.asc_nulls_last("doc_id")]
    rows = rows.repartitionByRange("lead", "digest", *tail).sortWithinPartitions("lead", "digest", "norm", *tail)

    def runs(batches):
        base = TaskContext.get().partitionId() << 32
        n, last, held, first = -1, None, [], True

        def flush(edge: bool):
            ids, points, digest, number = pa.concat_arrays([h[0] for h in held]), held[0][1], held[0][2], base + n
            size = len(ids)
            head = np.zeros(size, bool)
            head[0] = True
            full = lambda v, t: pa.repeat(pa.scalar(v, t), size)
            columns = [ids, full(ids[0].as_py(), pa.int64()), full(points, pa.int64()), full(size, pa.int64()), full(digest, pa.string()), full(number, pa.int64()), pa.array(head), full(edge, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=[k for k, _ in _TYPES])

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            text, ids, points = batch.column("norm"), batch.column("doc_id"), batch.column("points")
            same = np.zeros(len(text), bool)
            same[0] = last is not None and text[0].as_py() == last
            if len(text) > 1:
                same[1:] = pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(~same).tolist(), len(text)]
            if same[0]:
                held.append((ids.slice(0, cuts[0]), None, None))
            for a, b in zip(cuts, cuts[1:]):
                if held:
                    ready.append(flush(first))
                    first, held = False, []
                n += 1
                held.append((ids.slice(a, b - a), points[a].as_py(), hashlib.sha256(text[a].as_py()).hexdigest()))
            last = text[len(text) - 1].as_py()
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
        if held:
            yield flush(True)

    found = materialize(rows.select("doc_id", "points", "norm").mapInArrow(runs, _RUNS), out)
    best = F.struct(-F.col("points"), F.col("keep_id").isNull(), "keep_id", "run")
    joined = (
        found.where("edge AND head")  # two a partition at most
        .groupBy("text_sha256")
        .agg(F.sum("group_size").alias("total"), F.min(best).alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select("text_sha256", F.lit(True).alias("edge"), "total", F.col("best.keep_id").alias("first_id"), F.col("best.run").alias("first_run"))
    )
    joined = materialize(joined, f"{out}-edges")
    few = joined.count() <= BROADCAST_ROWS  # at most one a partition; a hot text's rows stay where they are
    both = found.join(F.broadcast(joined) if few else joined, ["text_sha256", "edge"], "left")
    split = F.col("total").isNotNull()
    return both.select(
        "doc_id",
        F.when(split, F.col("first_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("total", "group_size").alias("group_size"),
        (F.col("head") & F.coalesce(F.col("run") == F.col("first_run"), F.lit(True))).alias("kept"),
        "text_sha256",
    )


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def drop_exact_duplicates(docs: DataFrame, out: str) -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    Dropped rows leave by an anti join on doc_id and digest, a shuffle at every size: their list grows with the table. Of rows that
    share both, where one of them stays, the longest original does, then the first by text.
    """
    found = materialize(exact_duplicates(docs, f"{out}/runs").groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), f"{out}/keys")
    sha = lambda c: F.sha2(F.translate(text_or_empty(c), SPACES, "").cast("binary"), 256)

    def by_key(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """By names with an alias, for the table may have columns of any name."""
        on = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (sha("d.text") == F.col("k.text_sha256"))
        return rows.alias("d").join(keys.select("doc_id", "text_sha256").hint("merge").alias("k"), on, how)

    lone = by_key(docs, found, "left_anti")
    repeated = found.where("kept")
    if repeated.isEmpty():
        return lone
    rows = by_key(docs, repeated, "left_semi").select(F.struct(*map(_quoted, docs.columns)).alias("row"), "doc_id", "text", sha("text").alias("key"))
    order = Window.partitionBy("doc_id", "key").orderBy(F.desc(F.length(text_or_empty())), "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    return lone.unionByName(rows.where("place = 1").select("row.*"))
