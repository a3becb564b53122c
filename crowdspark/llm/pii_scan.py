"""Personal data in texts: fixed patterns, and spans that a character tagger adds to what they find."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .tagger import Tagger, best_path, symbols

#: Kinds in their order: those of the patterns, then those of the tagger.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"{k}_like" for k in BASE))
# The base patterns, written so that each reads a text once.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: What numbers and marks that are no personal data are found by for training, with REACH characters to both sides.
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
REACH, WINDOW, STEP, WINDOWS_AT_ONCE = 24, 64, 32, 1024
#: The tagger learns from spans of that many documents (least hashes of their ids), that many of a kind, each rewritten in FORMS ways.
SAMPLE_ROWS, SAMPLE_SPANS, FORMS, ROUNDS = 20_000, 120, 4, 8
#: Least chance that every character of an added span has.
SURE = 0.6
#: Characters of a labelled span that a window may leave out.
CUT_OFF = 6
TAGS = 1 + 2 * len(BASE)  # none, and first and further characters of each kind
ALLOWED = np.array([[b % 2 == 1 or b == 0 or (a > 0 and b in (a, a + 1) and b == (a + 1) // 2 * 2) for b in range(TAGS)] for a in range(TAGS)])


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind; in order of kind and start. Linear in the text."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        local = text[end:at]
        domain = _DOMAIN.match(text, at + 1) if (size := len(local) - len(local.rstrip(_LOCAL))) else None
        if domain:
            found.append((0, at - size, domain.end()))
        end = domain.end() if domain else at + 1
        at = text.find("@", end)
    if not _DIGIT.search(text):
        return found
    for m in _DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            stop = start + sum(map(len, parts[k : k + 4])) + 3
            if all(map(_small, parts[k : k + 4])):
                found.append((1, start, stop))
            start = stop + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# What an added span has to be made of. Fixed values.
_AT, _DOT = r"(?: ?[(\[]at[)\]] ?| at |@)", r"(?: ?[(\[]dot[)\]] ?| dot |\.)"
_SHAPES = (
    re.compile(rf"[a-z0-9._%+-]+{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+", re.IGNORECASE),
    re.compile(r"[0-9]+(?:(?:\[\.\]|\(\.\)|\[dot\]| \. )[0-9]+){3}"),
    re.compile(r"[0-9]{2,}(?:[\x20./_-]{1,2}[0-9]{2,})+"),
    re.compile(r"(?:\+|00)?[0-9]*[\x20./-]{0,2}(?:\([0-9]+\)[\x20./-]{0,2})?[0-9]+(?:[\x20./-][0-9]+)+"),
)


def confirmed(kind: int, span: str) -> bool:
    """Whether a span of the tagger is built as its kind demands: numbers up to 255, a card's check digit, digits enough for a phone in groups."""
    if not _SHAPES[kind].fullmatch(span):
        return False
    digits = re.sub("[^0-9]", "", span)
    if kind == 1:
        return all(map(_small, re.findall("[0-9]+", span)))
    return kind == 0 or (13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15)


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, joined where they touch."""
    found = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if found and start <= found[-1][1]:
            found[-1][1] = end
        else:
            found.append([start, end])
    return [tuple(s) for s in found]


# Where a span that ``confirmed`` takes can lie at all: the mark of an address, what may follow it, and digits with what may part them.
_MARK = re.compile(r"@|[(\[]at[)\]]| at(?= )", re.IGNORECASE)
_AFTER = re.compile(rf"\x20?[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+", re.IGNORECASE)
_NUMBERS = re.compile(r"[0-9](?:(?:[0-9+()\x20./_\[\]-]|dot)*[0-9])?")
_GROUP = re.compile("[0-9]+")
_LEAD = 4  # characters that can stand before a span's first digit: a plus, two that part, a bracket


def possible(text: str) -> list[tuple[int, int]]:
    """Stretches outside of which no part of a span lies that ``confirmed`` would take, in order and apart. Linear in the text.

    An address needs a mark with a local part before it and a dotted name after it; the other kinds need four groups of digits or ten digits,
    with nothing but their marks between.
    """
    found, end = [], 0
    for m in _MARK.finditer(text):
        before = text[end : m.start()]
        bare = before[:-1] if before[-1:] == " " and m[0] != "@" and m[0][0] != " " else before
        size = len(bare) - len(bare.rstrip(_LOCAL + "\u0130\u0131\u017f\u212a"))  # the last four are letters of a to z but for their case
        after = _AFTER.match(text, m.end()) if size else None
        if after:
            found.append((end + len(bare) - size, after.end()))
        end = m.start() + 1 if m[0][0] == " " else m.end()  # the word ``at`` can be a local part too
    for m in _NUMBERS.finditer(text):
        groups = _GROUP.findall(m[0])
        if len(groups) >= 4 or sum(map(len, groups)) >= 10:
            found.append((max(0, m.start() - _LEAD), m.end()))
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return [tuple(s) for s in joined]


def _begin(k: int) -> int:
    """Where a text's ``k``-th window begins; windows overlap by half, the first begins before the text."""
    return k * STEP - (WINDOW - STEP) // 2


def _holding(a: int, b: int, length: int) -> range:
    """Numbers of the windows that hold a place from ``a`` to ``b`` of a text."""
    last = max(1, -(-(max(1, length - STEP // 2) - _begin(0)) // STEP))
    return range(max(0, (a - WINDOW - _begin(0)) // STEP + 1), min(last, -(-(b - _begin(0)) // STEP)))


#: Share of a window's opinion on a place: it grows with the distance from the window's edges.
_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32) ** 2


def blended(made: dict[int, np.ndarray], a: int, b: int, length: int) -> np.ndarray:
    """Tag chances of the places from ``a`` to ``b`` of a text: every window is decoded on its own (``made``), then all that hold a place are weighed."""
    heap = np.zeros((b - a, TAGS + 1), np.float32)
    for k in _holding(a, b, length):
        begin = _begin(k)
        lo, hi = max(a, begin), min(b, begin + WINDOW)
        heap[lo - a : hi - a, :-1] += made[k][lo - begin : hi - begin] * _WEIGHT[lo - begin : hi - begin, None]
        heap[lo - a : hi - a, -1] += _WEIGHT[lo - begin : hi - begin]
    return heap[:, :-1] / heap[:, -1:]


def _decode(tagger: Tagger, texts: dict[int, str], wanted: list[tuple[int, int]], made: dict[int, dict[int, np.ndarray]]) -> None:
    """Add the chances of windows (text, number) to ``made``, many windows at once; symbols beside a text are 0."""
    codes = []
    for i, k in wanted:
        begin, text = _begin(k), texts[i]
        part = symbols(text[max(0, begin) : begin + WINDOW])
        row = np.zeros(WINDOW, np.int64)
        row[max(0, -begin) : max(0, -begin) + len(part)] = part
        codes.append(row)
    for at in range(0, len(wanted), WINDOWS_AT_ONCE):
        for (i, k), c in zip(wanted[at : at + WINDOWS_AT_ONCE], tagger.chances(np.stack(codes[at : at + WINDOWS_AT_ONCE]))):
            made[i][k] = c


#: Chance of no tag from which on a place is in no doubt; best paths are found between such places.
CLEAR = 0.995


def tagged(chances: np.ndarray, sure: float = SURE) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans on the one best path over a whole stretch whose characters all reach ``sure``."""
    loose = np.flatnonzero(np.diff(np.concatenate([[0], (chances[:, 0] < CLEAR).astype(np.int8), [0]])))  # between them nothing is in doubt
    found = []
    for a, b in loose.reshape(-1, 2):
        path = best_path(chances[a:b], ALLOWED)
        first = np.flatnonzero(path % 2 == 1)
        for s in first:
            rest = path[s + 1 :] != path[s] + 1
            e = s + 1 + (int(rest.argmax()) if rest.any() else len(rest))
            if chances[a + np.arange(s, e), path[s:e]].min() >= sure:
                found.append((int(path[s]) // 2, int(a + s), int(a + e)))
    return found


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans of the tagger in each text that are built as their kind demands and meet no base span; kinds follow the base ones.

    The result is that of looking at every window of every text: windows lie on one grid over the whole text, and only those are left out
    that no span built so can touch, or a base span has taken. From what is ``possible``, windows are added on both sides until a place without doubt or the text's end is met, for the best path goes that far.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    open_: list[list[int]] = []
    for i, text in enumerate(texts):
        starts, ends = zip(*sorted((a, b) for _, a, b in base[i])) if base[i] else ((), ())
        for a, b in possible(text):
            k = bisect_right(starts, a)
            if not k or ends[k - 1] < b:
                open_.append([i, max(0, a - 1), min(len(text), b + 1)])
    made: dict[int, dict[int, np.ndarray]] = {i: {} for i, _, _ in open_}
    spans: dict[int, set] = {i: set() for i in made}
    held = {i: texts[i] for i in made}
    while open_:
        _decode(tagger, held, sorted({(i, k) for i, a, b in open_ for k in _holding(a, b, len(texts[i])) if k not in made[i]}), made)
        wider = []
        for i, a, b in open_:
            chances, size = blended(made[i], a, b, len(texts[i])), len(texts[i])
            left, right = a > 0 and chances[0, 0] < CLEAR, b < size and chances[-1, 0] < CLEAR
            if left or right:
                wider.append([i, max(0, a - STEP) if left else a, min(size, b + STEP) if right else b])
            else:
                spans[i].update((k + len(BASE), a + s, a + e) for k, s, e in tagged(chances) if confirmed(k, texts[i][a + s : a + e]))
        open_ = wider
    for i, new in spans.items():
        found[i] = sorted(new)
    for i, spans in enumerate(found):
        held = sorted((a, b) for _, a, b in base[i])
        starts, ends = [a for a, _ in held], np.maximum.accumulate([b for _, b in held]) if held else []
        found[i] = [s for s in spans if not (k := bisect_right(starts, s[2] - 1)) or ends[k - 1] <= s[1]]
    return found


def _rewritten(kind: int, span: str, make: random.Random) -> str:
    """The labelled span in another spelling of the same kind; its digits are drawn anew."""
    digits = lambda n: "".join(make.choice("0123456789") for _ in range(n))
    if kind == 0:
        local, _, domain = span.partition("@")
        at, dot = make.choice([("@", "."), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", ".")])
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return make.choice([".", "[.]", "(.)", "[dot]", " . "]).join(str(make.randrange(256)) for _ in range(4))
    if kind == 2:
        sizes = make.choice([(16,), (4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (13,)])
        return make.choice([" ", "-", ".", "/", "_", " - "[1:], "  "]).join(map(digits, sizes))
    area, mark = digits(3), make.choice(" .-/")
    lead = make.choice(["", "", f"+{digits(make.choice((1, 2)))} ", f"00{digits(2)} ", "+1-", "+1 "])
    return lead + make.choice([f"({area}) ", f"{area}{mark}", f"({area}){mark}"]) + make.choice([digits(3) + mark + digits(4), f"{digits(3)}-{digits(4)}", digits(4) + mark + digits(4), f"{digits(2)}{mark}{digits(2)}{mark}{digits(3)}"])


def _harmless(make: random.Random) -> str:
    """Digits and at-signs that are no personal data."""
    digits = lambda a, b: "".join(make.choice("0123456789") for _ in range(make.randint(a, b)))
    forms = (
        lambda: digits(1, 8), lambda: digits(20, 40), lambda: "".join(make.choice("0123456789abcdef") for _ in range(make.choice((8, 32, 40)))), lambda: f"{digits(1, 3)}.{digits(1, 3)}",
        lambda: f"v{digits(1, 2)}.{digits(1, 2)}.{digits(1, 2)}", lambda: f"{make.randint(1900, 2099)}-{make.randint(1, 12):02}-{make.randint(1, 31):02}", lambda: f"{make.randint(0, 23):02}:{make.randint(0, 59):02}:{make.randint(0, 59):02}",
        lambda: f"{make.randint(1, 31)}.{make.randint(1, 12)}.{make.randint(1900, 2099)}", lambda: f"{digits(1, 3)},{digits(3, 3)}.{digits(2, 2)}", lambda: f"{digits(2, 3)}-{digits(2, 3)}", lambda: f"({digits(1, 3)})", lambda: f"{digits(1, 2)}. ", lambda: f"§{digits(1, 3)}",
        lambda: "@" + make.choice(("home", "user1", "all")), lambda: f"{digits(1, 2)} (at) once", lambda: f"ISBN {digits(3, 3)}-{digits(1, 1)}-{digits(2, 2)}-{digits(6, 6)}-{digits(1, 1)}", lambda: " ".join(digits(1, 3) for _ in range(make.randint(3, 8))), lambda: f"{digits(5, 9)}/{digits(2, 2)}",
    )
    return make.choice(forms)()


def training_set(spans: list[tuple[int, str, str, str]], forms: int = FORMS, most: int = SAMPLE_SPANS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from labelled spans (kind, text before, span, text after); kind -1 has no span.

    Every span comes as it is and in ``forms`` spellings; kinds with fewer than ``most`` spans repeat theirs, and one without any is written by rule.
    """
    make = random.Random(seed)
    around = [(b, a) for _, b, _, a in spans] or [("", "")]
    plain = {0: "ann.01@mail.example.com", 1: "192.0.2.1", 2: "4111 1111 1111 1111", 3: "+1 (200) 555-0100"}
    pieces = []
    for kind in range(len(BASE)):
        own = [s for s in spans if s[0] == kind] or [(kind, b, plain[kind], a) for b, a in around[:most]]
        for i in range(max(len(own), most // 2)):
            _, before, span, after = own[i % len(own)]
            pieces += [(kind, before, text, after) for text in (span, *(_rewritten(kind, span, make) for _ in range(forms)))]
    for i in range(most * forms // 2):
        before, after = around[i % len(around)]
        pieces.append((-1, before, _harmless(make), after))
    pieces += [s for s in spans if s[0] < 0]
    windows, tags = np.zeros((len(pieces), WINDOW), np.int64), np.zeros((len(pieces), WINDOW), np.int64)
    for row, (kind, before, span, after) in enumerate(pieces):
        before = before + (make.choice(("", " ")) if not before or before[-1].isspace() else " ")
        after = ("" if not after or not after[0].isalnum() else " ") + after
        before, after = before[len(before) - make.randint(0, len(before)) :], after[: make.randint(0, len(after))]  # stretches end near a span
        text, first, last = before + span + after, len(before), len(before) + len(span)
        ends = sorted((last - WINDOW, first))
        begin = make.randint(ends[0] - CUT_OFF, ends[1] + CUT_OFF)  # windows may cut a span
        from_ = min(max(0, begin), len(text))
        seen = slice(from_, max(from_, min(len(text), begin + WINDOW)))
        codes, marks = symbols(text), np.zeros(len(text), np.int64)
        if kind >= 0:
            marks[first:last] = 2 * kind + 2
            marks[first : first + 1] = 2 * kind + 1
        windows[row, seen.start - begin : seen.stop - begin], tags[row, seen.start - begin : seen.stop - begin] = codes[seen], marks[seen]
    return windows, tags


def labelled_spans(docs: DataFrame, folder: str, rows: int = SAMPLE_ROWS, most: int = SAMPLE_SPANS) -> list[tuple[int, str, str, str]]:
    """A bounded sample of base spans with what stands around them, and of numbers that are none: ``most`` a kind, of the ``rows`` documents with the least hash of their id."""
    place = F.xxhash64("doc_id")
    last = docs.select(place.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return []

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                out += [(k, text[max(0, a - WINDOW) : a], text[a:b], text[b : b + WINDOW]) for k, a, b in base if b - a <= WINDOW]
                near = {c for _, a, b in base for c in range(a - WINDOW, b + WINDOW)}
                for a, b in stretches(text or ""):
                    if a not in near and b not in near and b - a <= WINDOW:
                        out.append((-1, text[a : a + REACH], text[a + REACH : b - REACH], text[max(a + REACH, b - REACH) : b]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int32()] + [pa.string()] * 3)], names=["kind", "before", "span", "after"])

    found = materialize(docs.where(place <= last).select("text").mapInArrow(run, "kind int, before string, span string, after string"), folder)
    order = F.xxhash64("before", "span", "after")
    return [tuple(r) for k in range(-1, len(BASE)) for r in found.where(F.col("kind") == k).orderBy(order, "before", "span", "after").limit(most).collect()]


def train(docs: DataFrame, folder: str) -> Tagger:
    tagger = Tagger(TAGS)
    tagger.fit(*training_set(labelled_spans(docs, folder)), ROUNDS)
    return tagger


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan_personal_data(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts of base spans by kind, their digest, and all spans as ``kind:start:end``.

    Offsets are in code points, ends exclusive; spans come in the order of KINDS, then by start. Base spans are those of the patterns; the tagger adds
    ``<kind>_like`` spans in spellings that the patterns miss, where it is sure, the span is built as the kind demands, and no base span is met. Texts are read
    whole and in linear time; windows that no such span can touch are not decoded (``possible``). Null text counts as empty; repeated rows give repeated
    rows; a null id stays null; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(tagger, texts, base)
                write = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
                counts = [pa.array([sum(k == kind for k, *_ in b) for b in base], pa.int64()) for kind in range(len(BASE))]
                digests = [hashlib.sha256(write(b).encode()).hexdigest() for b in base]
                spans = [write(b + m) for b, m in zip(base, more)]
                yield pa.RecordBatch.from_arrays([ids, *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(list(map(len, more)), pa.int64())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
