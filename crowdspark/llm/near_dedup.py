"""Near-duplicates by an inverted join of MinHash signature coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .shingles import MAX_TEXTS, digests, shingle_sets, signatures, similar

COORDINATES = 64
#: Coordinates that must agree. A pair at similarity 0.75 agrees in 48 on average, with a deviation of 3.5.
MATCHES = 31
PERCENT = 75
#: A block of m texts is cut into chunks of about 8 * sqrt(m), LARGEST texts and SHINGLES fingerprints at most.
LARGEST, SHINGLES = 16_384, 8_000_000


def _members(docs: DataFrame, out: str) -> DataFrame:
    """(doc_id, body, n_shingles, node, postings): ``body`` is the text's hash, ``node`` its set's digest, a posting a coordinate with its value."""
    salts = np.random.default_rng(21).integers(1, 1 << 63, COORDINATES, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, MAX_TEXTS):
                    piece = part.slice(at, MAX_TEXTS)
                    values, offsets = shingle_sets(piece.column("text"))
                    posts = (signatures(values, offsets, COORDINATES) ^ salts).view(np.int64)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, posts.size + 1, COORDINATES, dtype=np.int32)), pa.array(posts.ravel()))
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("body"), pa.array(np.diff(offsets)), pa.array(digests(values, offsets).view(np.int64)), flat], names=["doc_id", "body", "n_shingles", "node", "postings"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("body"))
    return materialize(rows.mapInArrow(run, "doc_id long, body long, n_shingles long, node long, postings array<long>"), out)


def components(edges: DataFrame, out: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, label), label being one of the component's nodes.

    In each round every vertex takes the least of itself and its neighbours, edges are drawn anew between what
    their ends took, and vertices follow. Nodes are hashes, so a round leaves a fraction of the vertices of any
    shape; rounds go on until no edge is left. All steps are joins, and each round is cut off in a written table.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{out}/edges-0")
    labels = None
    step = 0
    while not edges.isEmpty():
        step += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{out}/least-{step}")
        if labels is None:
            labels = least.select(F.col("a").alias("node"), F.col("m").alias("label"))
        else:
            labels = labels.join(least, labels["label"] == least["a"], "left").select("node", F.coalesce("m", "label").alias("label"))
        labels = materialize(labels, f"{out}/labels-{step}")
        left = least.select("a", F.col("m").alias("x"))
        right = least.select(F.col("a").alias("b"), F.col("m").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialize(edges, f"{out}/edges-{step}")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def prefix_postings(classes: DataFrame) -> DataFrame:
    """(token, node, n_shingles) of ``classes(node, n_shingles, postings)``: the inverted lists that a match can't avoid.

    Postings that one class only has drop out, and so do classes with fewer than MATCHES shared ones. Of the others
    each class is posted under all but its MATCHES - 1 most frequent, in one order for all (frequency, then token):
    two classes that agree in MATCHES coordinates share one of these.
    """
    posted = classes.select("node", "n_shingles", F.explode("postings").alias("token"))
    frequency = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = posted.join(frequency, "token")
    by_class = Window.partitionBy("node")  # COORDINATES rows
    ranked = shared.withColumn("k", F.row_number().over(by_class.orderBy("df", "token"))).withColumn("n", F.count("*").over(by_class))
    return ranked.where(F.col("k") <= F.col("n") - (MATCHES - 1)).select("token", "node", "n_shingles")


def list_edges(lists: DataFrame) -> DataFrame:
    """(a, b): the least class of each posting list with each of its others, so as many edges as postings."""
    hubs = lists.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("token", "a")
    return lists.join(hubs, "token").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def merge_lists(sign: np.ndarray):
    """For each row of signatures the earlier rows that its prefix postings meet.

    The inverted lists of these rows are ordered by length; a row's prefix is all its shared postings but its
    MATCHES - 1 longest, and rows with fewer than MATCHES shared ones meet nothing.
    """
    n, k = sign.shape
    token = np.empty((n, k), np.int64)
    df = np.empty((n, k), np.int64)
    total = 0
    for i in range(k):
        _, back, count = np.unique(sign[:, i], return_inverse=True, return_counts=True)
        token[:, i], df[:, i], total = back + total, count[back], total + len(count)
    order = np.lexsort((token, df))
    token, df = np.take_along_axis(token, order, 1), np.take_along_axis(df, order, 1)
    shared = (df > 1).sum(axis=1)
    place = np.arange(k)
    prefix = (df > 1) & (place[None, :] < k - (MATCHES - 1)) & (shared >= MATCHES)[:, None]
    own, at = np.nonzero(prefix)
    posted = token[own, at]
    by = np.lexsort((own, posted))
    own, posted = own[by], posted[by]
    first = np.searchsorted(posted, posted)
    nth = np.arange(len(posted)) - first  # earlier members of the list
    by_row = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[by_row], np.arange(n + 1))
    mark = np.zeros(n, bool)
    for i in range(n):
        for p in by_row[ends[i] : ends[i + 1]].tolist():
            mark[own[first[p] : first[p] + nth[p]]] = True
        yield np.flatnonzero(mark[:i])
        mark[:i] = False


def link_block(nodes: list[int], sets: list[np.ndarray], sign: np.ndarray, chunks: np.ndarray) -> list[tuple[int, int]]:
    """Confirmed links within a block that join up all its similar texts, as few as do.

    With two chunks only pairs across them are looked at. Each text is counted against the earlier ones that the
    merged lists give it, without those that are joined to it already; of any other group the pair that agrees most
    is confirmed on full sets first, and the group is left as soon as one pair is.
    """
    size, group, links = np.array([len(x) for x in sets]), np.arange(len(nodes)), []
    across = len(set(chunks.tolist())) > 1
    for i, near in enumerate(merge_lists(sign)):
        near = near[(group[near] != group[i]) & (100 * np.minimum(size[near], size[i]) >= PERCENT * np.maximum(size[near], size[i])) & ((chunks[near] != chunks[i]) | (not across))]
        agree = (sign[near] == sign[i]).sum(axis=1)
        near, agree = near[agree >= MATCHES], agree[agree >= MATCHES]
        near = near[np.argsort(-agree, kind="stable")]
        while len(near):
            j, near = int(near[0]), near[1:]
            if similar(sets[i], sets[j], PERCENT):
                links.append((nodes[i], nodes[j]))
                group[group == group[j]] = group[i]
                near = near[group[near] != group[i]]
    return links


def shingle_table(docs: DataFrame, asked: DataFrame, out: str) -> DataFrame:
    """(node, values): the full set of each class of ``asked(node, doc_id, body)``, from the text of that row."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("body")).where("text IS NOT NULL")
    # By a shuffle at every size: the texts asked for grow with the table.
    on = F.col("t.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("t.body") == F.col("q.body"))
    found = asked.hint("merge").alias("q").join(texts.alias("t"), on).select("node", "text")

    def run(batches):
        last = None
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            fresh = np.concatenate([[nodes[0] != last] if len(nodes) else [], nodes[1:] != nodes[:-1]]).astype(bool)  # equal rows come one after the other
            last = nodes[-1] if len(nodes) else last
            for part in slices(batch.filter(pa.array(fresh)), "text"):
                for at in range(0, part.num_rows, MAX_TEXTS):
                    piece = part.slice(at, MAX_TEXTS)
                    values, offsets = shingle_sets(piece.column("text"))
                    yield pa.RecordBatch.from_arrays([piece.column("node"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))], names=["node", "values"])

    return materialize(found.mapInArrow(run, "node long, values array<long>"), out)


def near_duplicates(docs: DataFrame, out: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Texts with equal shingle sets are one class at once. Classes are posted under their coordinates' values
    (``prefix_postings``); lists that have a class in common make a block, so that every pair that can match is in
    one. A block is dealt out as tiles of two chunks each, where its posting lists are merged, collisions counted
    and links confirmed on full sets; only links leave a task. What is joined already is skipped, so a group of
    alike texts takes about one confirmation a text. A block of m texts moves about sqrt(m) / 8 times its sets, m /
    LARGEST times where it is very large; texts of a block that match but are not similar are counted pair by pair.
    A pair at the threshold is missed with a chance of about 1e-6; there is no cap on partners. Sets are
    fingerprints of 52 bits (two different shingles of two texts of 1,000 words pass for one with odds of 2e-10)
    and their digests have 64 bits.

    Null text and text without words link with nothing and have 0 shingles; rows that share a doc_id share a
    component only through their texts; a null doc_id is last in every order.
    """
    members = _members(docs, f"{out}/members")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "body")).alias("first")
    classes = members.where("n_shingles > 0").groupBy("node").agg(first, F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"), F.first("postings").alias("postings"))
    classes = materialize(classes, f"{out}/classes")
    lists = materialize(prefix_postings(classes), f"{out}/lists")
    blocks = components(list_edges(lists), f"{out}/blocks")
    inside = materialize(classes.select("node", "n_shingles", "first.doc_id", "first.body").join(blocks, "node"), f"{out}/inside")
    sets = shingle_table(docs, inside.select("node", "doc_id", "body"), f"{out}/sets")
    sizes = inside.groupBy("label").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    chunks = F.ceil(F.greatest(F.sqrt(F.col("m")) / 8, F.col("m") / LARGEST, F.col("s") / SHINGLES)).cast("long")
    placed = inside.select("node", "label").join(sizes.select("label", chunks.alias("chunks")), "label").join(sets, "node")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = placed.select("label", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", "node", "values")

    def confirm(table: pa.Table) -> pa.Table:
        values = table.column("values").combine_chunks()
        flat, edge = values.flatten().to_numpy().view(np.uint64), values.offsets.to_numpy().astype(np.int64)
        edge = edge - edge[0]
        sets_of = [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        sign = (signatures(flat, edge, COORDINATES) >> np.uint64(32)).astype(np.uint32)  # half will do within a tile
        links = link_block(table.column("node").to_pylist(), sets_of, sign, table.column("chunk").to_numpy())
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = materialize(dealt.groupBy("label", "ci", "cj").applyInArrow(confirm, "a long, b long"), f"{out}/links")
    labels = components(links, f"{out}/joined")
    both = classes.where("n > 1").select("node").join(labels, "node", "full").select("node", F.coalesce("label", "node").alias("label"))
    both = both.join(classes.select("node", F.struct("first.col1", "first.doc_id").alias("own")), "node")
    heads = both.groupBy("label").agg(F.min("own")["doc_id"].alias("component_id"))
    found = both.join(heads, "label").select("node", "component_id")
    result = members.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(found, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, out: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id heads its component, all columns; rows that share a doc_id stay or go together."""
    found = near_duplicates(docs, out).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept")
    dropped = materialize(found.select("doc_id"), f"{out}/dropped")
    return docs.alias("d").join(dropped.hint("merge").alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_anti")
