import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from crowdspark.llm import packing, token_files
from crowdspark.llm.common import run_dir
from crowdspark.llm import words as words_module
from crowdspark.llm.words import Encoder, Words, distinct

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_ids_of_whole_texts(plain):
    pick = random.Random(5)
    letters = "abcXYZ éÉÜß'.,!<|>*% \n\t\x0b\x1c  ́中ªſİ0123456789sdt"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(3000)]
    texts += ["<|startoftext|>x", "<|STARTOFTEXT|>x", None, "", "it's we'll WE'LL '' 's.'s", "İİ ΑΣ Σ"]
    coder = Encoder(PATH, limit=500)
    assert coder.by_word
    for at in range(0, len(texts), 250):
        part = texts[at : at + 250]
        ids, offsets = coder.encode(pa.array(part, pa.string()))
        for t, a, b in zip(part, offsets, offsets[1:]):
            assert ids[a:b].tolist() == plain(t), t


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_alike_to_polynomial_hashes(plain):
    a, b = thue_morse(1024)
    ids, offsets = Encoder(PATH).encode(pa.array([a, b, a]))
    assert [ids[x:y].tolist() for x, y in zip(offsets, offsets[1:])] == [plain(a), plain(b), plain(a)]


def test_words_of_one_hash_are_told_apart(plain, monkeypatch):
    """Hashes only find words; their bytes decide."""
    monkeypatch.setattr(Words, "hash", lambda self, place: self.size.astype(np.uint64) % np.uint64(3))
    texts = ["the cat the dog", "a cat, another dog", "internationalisation internationalizations the", "interna internationalisatiom a\0 a", "dog cat the"]
    coder = Encoder(PATH)
    for part in (texts, texts[::-1]):
        ids, offsets = coder.encode(pa.array(part))
        assert [ids[x:y].tolist() for x, y in zip(offsets, offsets[1:])] == [plain(t) for t in part]
    raw, offsets = words_module.text_bytes(pa.array(texts))
    starts, ends, _ = words_module.word_bounds(raw, offsets)
    first, inverse = distinct(Words(raw, starts, ends))
    names = [bytes(raw[a:b]) for a, b in zip(starts, ends)]
    assert len(first) == len(set(names)) and [names[first[i]] for i in inverse] == names


def test_token_files(spark, docs, rows, empty, plain):
    out = run_dir(spark, "t1")
    files = token_files.write_token_files(docs, out, PATH, 2)
    got = token_files.read_token_files(spark, out, files).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [g.doc_id for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        ids = plain(w[1]) + [2]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    flat = np.concatenate([token_files.open_token_file(out, f["name"], f["width"])[0] for f in files])
    assert flat.tolist() == [i for w in want for i in plain(w[1]) + [2]]
    out = run_dir(spark, "t1")
    assert token_files.read_token_files(spark, out, token_files.write_token_files(empty, out, PATH)).count() == 0


@pytest.mark.parametrize("length", [64, 100, 2048])
def test_packing(docs, rows, plain, length):
    got = packing.pack_documents(docs, PATH, length, 1).collect()
    by_doc = {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
    texts = {r[0]: plain(r[1]) + [1] for r in rows}
    twice = {17}
    for doc, ids in texts.items():
        pieces = sorted(by_doc[doc], key=lambda p: p.start)
        assert sum(p.length for p in pieces) == len(ids) * (1 + (doc in twice))
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for p in pieces)
        if doc not in twice:
            at = 0
            for p in pieces:
                assert p.start == at
                at += p.length
    fill = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0) and p.length > 0
        fill[p.sequence_id] = p.offset + p.length
    assert all(n <= length and (n == length or n & (n - 1) == 0) for n in fill.values())


def test_sum_of_squares_rule():
    """Each placement leaves the least sum of squared level counts among all levels it could take."""
    pick = random.Random(3)
    packer = packing.SquarePacker(16, most=10**6)
    for i in range(2000):
        size = pick.randrange(1, 16)
        before = packer.counts.copy()
        options = []
        for h in range(0, 16 - size + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 16
            options.append(int((after[1:16] ** 2).sum()))
        packer.put((i, 0, np.zeros(size, np.uint16), size))
        assert int((packer.counts[1:16] ** 2).sum()) == min(options)


def test_bounded_windows_lose_nothing():
    """With few windows allowed, items are cut to close one; all ids come out once, in order, in full or power-of-two windows."""
    pick = random.Random(8)
    for most in (1, 3, 40):
        packer = packing.SquarePacker(32, most)
        sizes = [pick.randrange(1, 32) for _ in range(500)]
        windows = []
        for i, size in enumerate(sizes):
            windows += packer.put((i, 0, np.arange(size), size))
            assert packer.held == packer.counts.sum() <= most
        windows += packer.rest()
        fills = [sum(len(p[2]) for p in w.pieces) for w in windows]
        assert all(f == 32 or f & (f - 1) == 0 for f in fills) and sum(fills) == sum(sizes)
        seen = {}
        for doc, start, ids, _ in (p for w in windows for p in w.pieces):
            assert ids[0] == start
            seen.setdefault(doc, []).extend(ids.tolist())
        assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(sizes))


def test_token_files_of_one_id(spark, plain):
    """Rows without an id, and with one: they fill several files, in the same order each time."""
    texts = [f"row {i} of many" for i in range(3000)]
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges would become one
    before = spark.conf.get(merge)
    for key in ("CAST(NULL AS long)", "CAST(7 AS long)"):
        df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr(f"{key} AS doc_id", "text").repartition(4)
        out = run_dir(spark, "t1")
        spark.conf.set(merge, False)
        try:
            files = token_files.write_token_files(df, out, PATH, 2)
        finally:
            spark.conf.set(merge, before)
        got = token_files.read_token_files(spark, out, files).orderBy("start").collect()
        assert len(files) > 1 and sorted(g.ids_crc32 for g in got) == sorted(crc(plain(t) + [2]) for t in texts)
        assert [g.start for g in got] == np.cumsum([0] + [g.n_tokens for g in got])[:-1].tolist()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("parts", [1, 8])
def test_the_rule_places_nearly_all(spark, sf, parts):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").repartition(parts)
    pieces = packing.pack_documents(docs, PATH).collect()
    short = [p for p in pieces if p.length < 2048]
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    total = sum(fill.values())
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill.values())
    assert padded < 0.02 * total and sum(p.length for p in short if p.placed) >= 0.9 * sum(p.length for p in short)


def test_packing_holds_what_the_rule_opens():
    """Lengths of all kinds at the default bound: the rule itself holds fewer windows, so no item is cut."""
    pick = random.Random(5)
    packer, full = packing.SquarePacker(2048), []
    for i in range(20_000):
        size = min(2047, 1 + int(pick.lognormvariate(6, 1.2))) if i % 3 else pick.randrange(1, 2048)
        full += packer.put((i, 0, np.zeros(size, np.uint16), size))
        assert packer.held < packing.OPEN_WINDOWS // 2
    assert full and not any(w.cut for w in full)
    few, cut = packing.SquarePacker(2048, 4), []
    for i in range(200):
        cut += few.put((i, 0, np.zeros(pick.randrange(1, 2048), np.uint16), 0))
    assert any(w.cut for w in cut) and few.held <= 4


def test_packing_empty(empty):
    assert packing.pack_documents(empty, PATH).count() == 0
