import hashlib
import random
import re
import time

import numpy as np
import pytest

from crowdspark.llm import pii_scan as P
from crowdspark.llm import tagger as G
from crowdspark.llm.common import run_dir


def luhn(digits):
    twice = [int(d) if i % 2 == 0 else 2 * int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def brute_base(text):
    """The patterns as the contract writes them."""
    number = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(number(s)) <= 19 and luhn(number(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(number(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, (p, fits) in enumerate(kinds) for m in re.finditer(p, text) if fits(m[0])]


ODD = [
    "", "@", "a@b", "a@b.c", "a@b.c.", "a@b.c@d.e", "x@y.z_d@e.f.g", ".@-.-", "é.a@b.c", "a@b..c x@y.z", "@@a@b.c", "a b@c.d,e@f.g", "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "256.1.1.1", "0256.01.1.1", "1..2.3.4.5", "300.1.1.1.1.1.1.1.9",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0000000000000", "0" * 19, "0" * 20, "4111 1111 1111 1111 2", "+1 (200) 555-0100", "+1 200", "++12345678 9", "+1((((((", "+123456789012345", "+1234567890123456", "+12 34 56 78 9 x", "١٢٣@b.c ١.٢.٣.٤",
]


def test_base_spans_as_the_patterns_say():
    make = random.Random(2)
    texts = ODD + ["".join(make.choice("ab01 .-@+(),é\n") for _ in range(make.randrange(60))) for _ in range(4000)] + ["".join(make.choice("01 -.+") for _ in range(40)) for _ in range(2000)]
    for text in texts:
        assert P.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("text", ["a" * 3_000_000 + "@", "1" * 3_000_000, "1." * 1_000_000, "+1" + "(" * 2_000_000, "a@" * 1_000_000, "+1" * 1_000_000, "1 " * 1_000_000])
def test_base_spans_in_linear_time(text):
    began = time.time()
    P.base_spans(text)
    assert time.time() - began < 8


def test_slopes_are_those_of_the_loss():
    make = np.random.default_rng(0)
    model = G.Tagger(5, 4, 3)
    model.w = {k: (w + make.normal(0, 0.3, w.shape)).astype(np.float64) for k, w in model.w.items()}
    x, y = make.integers(0, G.SYMBOLS, (3, 7)), make.integers(0, 5, (3, 7))
    slopes = model.slopes(x, y)[1]
    for name, w in model.w.items():
        for at in [(x[0, 0], 1), (x[1, 3], 2)] if name == "embed" else [tuple(make.integers(0, n) for n in w.shape) for _ in range(3)]:
            old = w[at]
            w[at] = old + 0.01
            above = model.slopes(x, y)[0]
            w[at] = old - 0.01
            below = model.slopes(x, y)[0]
            w[at] = old
            assert abs((above - below) / 0.02 - slopes[name][at]) < 2e-3, name


def test_chances_and_path_against_all_paths():
    import itertools

    make = np.random.default_rng(1)
    model = G.Tagger(3, 4, 3)
    model.w = {k: make.normal(0, 0.7, w.shape).astype(np.float32) for k, w in model.w.items()}
    x = make.integers(0, G.SYMBOLS, (2, 5))
    scores = model.scores(model.states(x))
    for n in range(2):
        weigh = {p: np.exp(model.w["start"][p[0]] + model.w["end"][p[-1]] + sum(scores[t, n, k] for t, k in enumerate(p)) + sum(model.w["step"][a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=5)}
        want = np.array([[sum(w for p, w in weigh.items() if p[t] == k) for k in range(3)] for t in range(5)]) / sum(weigh.values())
        assert np.allclose(model.chances(x)[n], want, atol=1e-4)
        assert np.allclose(model.posteriors(scores)[1][:, n], want, atol=1e-4)
    chances, allowed = make.dirichlet(np.ones(3), 6), np.array([[1, 1, 0], [1, 1, 1], [1, 0, 1]], bool)
    paths = [p for p in itertools.product(range(3), repeat=6) if allowed[0, p[0]] and all(allowed[a, b] for a, b in zip(p, p[1:]))]
    assert tuple(G.best_path(chances, allowed)) == max(paths, key=lambda p: np.prod([chances[t, k] for t, k in enumerate(p)]))


def test_allowed_steps_keep_spans_whole():
    names = ["O"] + [f"{c}{k}" for k in range(4) for c in "BI"]
    want = [[b[0] in "OB" or (a[0] in "BI" and a[1:] == b[1:]) for b in names] for a in names]
    assert P.ALLOWED.tolist() == want


PLAIN = ["the meeting of the old house was then moved to", "la casa de los tres que tienen el", "und dann ist er mit dem Haus", "as said before in the list of"]
SAID = {0: "ann.lee{n}@mail{n}.example.com", 1: "10.{n}.0.7", 2: "4111 1111 1111 1111", 3: "+1 (2{n}0) 555-0100"}


def labelled():
    make = random.Random(5)
    return [(k, make.choice(PLAIN)[: make.randint(5, 60)] + " ", SAID[k].format(n=make.randint(1, 9)), " " + make.choice(PLAIN)) for k in SAID for _ in range(40)]


@pytest.fixture(scope="module")
def model():
    found = G.Tagger(P.TAGS)
    losses = found.fit(*P.training_set(labelled(), most=120), 6)
    assert losses[-1] < losses[0] / 10
    return found


def test_held_out_accuracy(model):
    windows, tags = P.training_set(labelled(), most=60, seed=99)
    got = model.chances(windows).argmax(2)
    assert (got == tags).mean() > 0.96 and (got == tags)[tags > 0].mean() > 0.93


def test_added_spans(model):
    texts = ["so call (184) 555-7766 today, or", "mail to ann.lee [at] mail4.example [dot] com then", "the host 10[.]0[.]0[.]1 was", "the card 4111.1111.1111.1111 of", "the card 4111.1111.1111.1112 of", "in 2024 there were 17 of them", "no number at all", "ann@b.example.com"]
    base = [P.base_spans(t) for t in texts]
    more = P.added_spans(model, texts, base)
    said = [[(P.KINDS[k], t[a:b]) for k, a, b in m] for t, m in zip(texts, more)]
    assert said == [[("phone_like", "(184) 555-7766")], [("email_like", "ann.lee [at] mail4.example [dot] com")], [("ip_like", "10[.]0[.]0[.]1")], [("card_like", "4111.1111.1111.1111")], [], [], [], []]


def test_added_spans_do_not_depend_on_the_cut(model, monkeypatch):
    make = random.Random(8)
    text = " ".join(make.choice([*PLAIN, "(184) 555-7766", "10[.]0[.]0[.]1", "17", "ann.lee (at) mail.example.com"]) for _ in range(300))
    whole = P.added_spans(model, [text, "", text], [[]] * 3)
    monkeypatch.setattr(P, "WINDOWS_AT_ONCE", 3)
    assert P.added_spans(model, [text, "", text], [[]] * 3) == whole and whole[0] == whole[2] and len(whole[0]) > 20


def test_added_spans_are_those_of_all_windows(model):
    """No window is left out that could tell: the same as every window of the whole text, decoded along one path."""
    make = random.Random(4)
    said = ["(184) 555-7766", "10[.]0[.]0[.]1", "17", "ann.lee (at) mail.example.com", "ann.lee at mail.example dot com", "a.very.long.local.part.of.an.address [at] mail4.example [dot] com", "4111.1111.1111.1111", "look at it", "ann@mail.example.com"]
    texts = [" ".join(make.choice([*PLAIN, *said]) for _ in range(make.randint(1, 40))) for _ in range(60)] + ["ann.lee at mail.example dot com", "", "@"]
    base = [P.base_spans(t) for t in texts]
    want = []
    for text, held in zip(texts, base):
        begins = range(-(P.WINDOW - P.STEP) // 2, max(1, len(text) - P.STEP // 2), P.STEP)
        codes = np.concatenate([np.zeros(P.WINDOW, np.int64), G.symbols(text), np.zeros(2 * P.WINDOW, np.int64)])
        heap = np.zeros((len(text) + 4 * P.WINDOW, P.TAGS + 1))
        for b, c in zip(begins, model.chances(np.stack([codes[b + P.WINDOW :][: P.WINDOW] for b in begins]))):
            heap[b + P.WINDOW : b + 2 * P.WINDOW] += np.concatenate([c, np.ones((P.WINDOW, 1))], 1) * P._WEIGHT[:, None]
        heap = heap[P.WINDOW : P.WINDOW + len(text)]
        spans = P.tagged(heap[:, :-1] / heap[:, -1:]) if text else []
        want.append(sorted((k + 4, a, b) for k, a, b in spans if P.confirmed(k, text[a:b]) and not any(x < b and a < y for _, x, y in held)))
    assert P.added_spans(model, texts, base) == want
    assert any(text[a:b] == "ann.lee at mail.example dot com" for text, spans in zip(texts, want) for _, a, b in spans)


def test_possible_leaves_out_no_span():
    make = random.Random(6)
    for _ in range(3000):
        text = "".join(make.choice(["a", "B-", "1", "22", "345", " at ", "(at)", "[AT] ", "@", ".", " dot ", "(dot)", "[.]", " ", "+", "(", ")", "-", "/", "\u017f", "\u212a"]) for _ in range(make.randrange(1, 26)))
        kept = P.possible(text)
        assert all(b < c for (_, b), (c, _) in zip(kept, kept[1:]))
        for a in range(len(text)):
            for b in range(a + 1, len(text) + 1):
                if any(P._SHAPES[k].fullmatch(text, a, b) and P.confirmed(k, text[a:b]) for k in range(4)):
                    assert any(x <= a and b <= y for x, y in kept), (text, text[a:b], kept)
    began = time.time()
    for text in ("a at " * 300_000, "1." * 500_000, "a@" * 500_000, "a" * 1_000_000 + "(at)", "dot" * 300_000):
        P.possible(text)
    assert time.time() - began < 20


def test_confirmed_shapes():
    good = [(0, "a (at) b.c"), (0, "a@b dot c"), (1, "1[.]2[.]3[.]255"), (2, "4111/1111/1111/1111"), (3, "(184) 555-7766"), (3, "0044 184 555 7766"), (3, "184.555.7766")]
    bad = [(0, "a at b"), (1, "1[.]2[.]3[.]256"), (1, "1.2.3"), (2, "4111/1111/1111/1112"), (2, "4111111111111111"), (3, "1845557766"), (3, "184-555"), (3, "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6")]
    assert all(P.confirmed(*g) for g in good) and not any(P.confirmed(*b) for b in bad)


def test_scan(spark, docs, rows, empty, model):
    got = {}
    for r in P.scan_personal_data(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc, text, _ in rows:
        base = brute_base(text or "")
        digest = hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        for r in got[doc]:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, *_ in base) for i in range(4)) and r.base_sha256 == digest
    assert sum(map(len, got.values())) == len(rows)
    assert P.scan_personal_data(empty, model).count() == 0
    mixed = spark.createDataFrame([(1, "é mail a@b.c and (184) 555-7766 to"), (1, "é mail a@b.c and (184) 555-7766 to"), (2, None)], "doc_id int, text string")
    assert sorted((r.doc_id, r.spans, r.n_added) for r in P.scan_personal_data(mixed, model).collect()) == [(1, "email:7:12,phone_like:17:31", 1)] * 2 + [(2, "", 0)]


def test_sample_is_bounded_and_labelled(spark, docs, empty):
    many = spark.createDataFrame([(i % 29, f"{PLAIN[i % 4]} {SAID[i % 4].format(n=i % 10)} then. " + PLAIN[1] * 3 + f" {i} " + PLAIN[2]) for i in range(600)], "doc_id long, text string")
    found = P.labelled_spans(many, run_dir(spark, "labels"), 200, 9)
    assert {k: sum(s[0] == k for s in found) for k in range(-1, 4)} == {k: 9 for k in range(-1, 4)}
    assert all(brute_base(s) == [(k, 0, len(s))] for k, _, s, _ in found if k >= 0)
    assert found == P.labelled_spans(many.repartition(7), run_dir(spark, "labels"), 200, 9)
    assert P.labelled_spans(empty, run_dir(spark, "labels")) == []
    windows, tags = P.training_set([])  # without labelled spans those written by rule stand in
    assert windows.shape == tags.shape and (tags > 0).any()
