from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_and_models import brute_components
from tests.llm.test_text_operators import SPACE, brute_statistics


def test_stages(spark):
    """Each stage against brute force on its own input."""
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    at = {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        at[name] = docs.collect()
        if name != "packing":
            assert docs.columns == documents.columns
    before = documents.collect()
    good = {r.doc_id for r in at["quality rules"]}
    for r in before:
        n, _, _, _, repeated = brute_statistics(r.text or "")
        failed = n < 20 or 100 * repeated > 30 * n
        assert not (failed and r.doc_id in good)
        if not failed and r.doc_id in labels and labels[r.doc_id].quality == 1:
            assert r.doc_id in good
    groups = {}
    for r in at["quality rules"]:
        key = SPACE.sub("", r.text)
        groups[key] = min(groups.get(key, (1,)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in at["exact dedup"]) == sorted(d for _, d in groups.values())
    label = brute_components([(r.doc_id, r.text) for r in at["exact dedup"]])
    assert sorted(r.doc_id for r in at["near dedup"]) == sorted(set(label.values()))
    mixed = {r.doc_id for r in at["mixing"]}
    assert mixed <= set(label.values()) and not any(labels[d].toxic for d in mixed if d in labels)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter()
    for p in at["packing"]:
        tokens[p.doc_id] += p.length
    want = Counter()
    for r in at["mixing"]:  # the mixture may draw a document several times
        want[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    assert tokens == want


def test_repeated_ids(spark, docs, empty):
    """Rows that share doc_id and text leave one; empty tables pass through."""
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, empty, "").count() == 0
    got = corpus_pipeline.exact(spark, docs, "").collect()
    assert Counter(r.doc_id for r in got) == Counter([3, 1, 8, 4, 10, 11, 12, 13, 14, 15, 16, 17, None])


SF = "/root/testdata/sf0.001"


def test_stages_on_odd_tables(spark, docs, rows, empty):
    """Nulls, empty and long texts, repeated rows and clashing names through every stage; an empty table through all of them."""
    clash = docs.withColumnsRenamed({"part": "_id", "run": "_key", "words": "label", "size": "node"}).withColumn("_order", F.lit(1)).withColumn("kept", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, clash, SF)
        if name != "packing":
            assert got.columns == clash.columns
            seen = Counter((r.doc_id, r.text, r._id, r.node) for r in got.collect())
            assert set(seen) <= {(d, t, "x", 2) for d, t, _ in rows}
        else:
            assert {r.doc_id for r in got.collect()} == {r[0] for r in rows}
    here = empty
    for name, stage in corpus_pipeline.STAGES:
        here = stage(spark, here, SF)
        assert here.count() == 0


def test_stages_one_after_the_other(spark, docs, rows):
    """On odd rows each stage works on all that the one before kept, and texts stay whole."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    here = docs.select(plain.columns).union(plain.withColumn("doc_id", F.col("doc_id") + 1000))
    texts = {r.doc_id: r.text for r in here.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        here = stage(spark, here, SF).cache()
    kept = here.collect()
    assert kept and all(r.text == texts[r.doc_id] for r in kept)


def test_equal_rows_in_every_stage(spark):
    """Equal rows with equal ids: exact dedup leaves one; the others handle them as one text."""
    text = " ".join(f"word{i} with some more words." for i in range(30))
    df = spark.createDataFrame([(1, text, "en", "s", 1)] * 5 + [(None, text + " other words follow here", "en", "s", 1)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.exact(spark, df, SF).count() == 2
    near = corpus_pipeline.near(spark, df, SF).collect()
    assert {r.doc_id for r in near} == {1} and len(near) == 5
