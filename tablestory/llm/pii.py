"""Personal data in texts: fixed patterns, and a linear-chain conditional random field that adds to them.

The field reads runs of words that hold a digit, an ``@`` or an ``(at)``; any other word is outside by
definition, so runs are independent of each other and the decoding of a run is exact. Its features are
word shapes only. It is trained on a small labelled table and decoded by Viterbi over many runs at once.

The table has two parts. Made examples, labelled as they are made, hold what the patterns miss: addresses
written with ``(at)``, national phone numbers, card numbers whose check digit is wrong, IPv6, numbers that
run into their neighbours, and what only looks alike (dates, versions, amounts, other identifiers). The
other part is at most ``TRAIN_DOCS`` texts picked by a hash of their id and labelled by the patterns,
without the runs that hold longer numbers which no pattern knows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Made examples, texts learned from, the words of a run that go together in training, and how many of a run are learned at most.
TRAIN_MADE, TRAIN_DOCS, TRAIN_RUN, RUN_WORDS = 2500, 500, 64, 256
#: Words are told apart by the first so many characters of their shape.
SHAPE_CHARS = 24
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_HASHED = 1 << 14

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_SEEN = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
_GAP = re.compile(r"[ \t\n\v\f\r]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` outwards, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    if not _SOME.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) <= 255 or int(p.lstrip("0")[:4] or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit, an ``@`` or an ``(at)``, as word spans."""
    held: list[tuple[int, int]] = []
    at = 0
    while found := _SEEN.search(text, at):
        start = found.start()
        while start > at and not _GAP.match(text[start - 1]):
            start -= 1
        gap = _GAP.search(text, found.end())
        end = gap.start() if gap else len(text)
        if held and text[held[-1][1]:start].strip(" \t\n\v\f\r"):
            yield held
            held = []
        held.append((start, end))
        at = end
    if held:
        yield held


_SPELLED = re.compile(r"\w[(\[]at[)\]]\w.*\.\w", re.IGNORECASE)
_shapes: dict[str, tuple[int, ...]] = {}


def shape_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word's shape; digits and letters are not told apart from others of their kind."""
    if word in _shapes:
        return _shapes[word]
    import zlib

    kinds = "".join("9" if c in "0123456789" else "a" if c.isalpha() else c for c in word[:4 * SHAPE_CHARS])
    short = re.sub(r"9+", "9", re.sub(r"a+", "a", kinds))
    digits = "".join(c for c in word if c in "0123456789")
    parts = re.split(r"[^0-9]+", word.strip("().,;:!?*$%&#\"'"))
    small = all(p and len(p) < 4 and int(p) < 256 for p in parts)
    named = [
        f"short {short[:SHAPE_CHARS]}", f"shape {kinds[:SHAPE_CHARS]}", f"first {kinds[:3]}", f"last {short[-3:]}", f"digits {min(len(digits), 20)}",
        f"at {word.count('@')} {'.' in word.partition('@')[2]} {bool(_SPELLED.search(word))} {word.count(':') > 1}", f"parts {min(len(parts), 6)} {small} {'.' in word}",
        f"sum {13 <= len(digits) <= 19 and luhn(digits)}", f"letters {any(c.isalpha() for c in word)}",
    ]
    out = tuple(zlib.crc32(x.encode()) % _HASHED for x in named)
    if len(_shapes) < 100_000:
        _shapes[word] = out
    return out


_FEATURES = 9


@dataclass
class Field:
    """Emission scores of features, transition scores of labels, scores of the first and last label."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def decode(self, sequences: list[list[tuple[int, ...]]]) -> list[np.ndarray]:
        """The best labels of each run. Runs of like length go together; each step handles all of them."""
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sequences)
        at = 0
        while at < len(order):
            longest, to = len(sequences[order[at]]), at + 1
            while to < len(order) and to - at < 4096 and len(sequences[order[to]]) == longest:
                to += 1
            rows = order[at:to]
            at = to
            if not longest:
                continue
            scores = self.emit[np.array([sequences[i] for i in rows])].sum(axis=2)
            best, back = scores[:, 0] + self.first, np.zeros((len(rows), longest, len(LABELS)), np.int8)
            for t in range(1, longest):
                ways = best[:, :, None] + self.move
                back[:, t] = ways.argmax(axis=1)
                best = ways.max(axis=1) + scores[:, t]
            label = (best + self.last).argmax(axis=1)
            path = np.zeros((len(rows), longest), np.int8)
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = back[np.arange(len(rows)), t, label]
            for i, p in zip(rows, path):
                out[i] = p
        return out


def fit(sequences: list[list[tuple[int, ...]]], labels: list[list[int]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood by full-batch AdaGrad; without sequences, everything is outside."""
    size = len(LABELS)
    w = [np.zeros((_HASHED, size)), np.zeros((size, size)), np.zeros(size), np.zeros(size)]
    if not sequences:
        w[2][0] = 1
        return Field(*w)
    w[2][0] = w[1][0, 0] = 0.5
    seen = [np.full_like(x, 1e-8) for x in w]
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        by_length.setdefault(len(s), []).append(i)
    blocks = [(np.array([sequences[i] for i in rows]), np.array([labels[i] for i in rows])) for _, rows in sorted(by_length.items())]
    soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for _ in range(rounds):
        emit, move, first, last = w
        grad = [-decay * x for x in w]
        for x, y in blocks:
            n, length = y.shape
            scores = emit[x].sum(axis=2)
            fore, rear = np.zeros((n, length, size)), np.zeros((n, length, size))
            fore[:, 0] = scores[:, 0] + first
            for t in range(1, length):
                fore[:, t] = soft(fore[:, t - 1][:, :, None] + move, 1) + scores[:, t]
            rear[:, -1] = last
            for t in range(length - 2, -1, -1):
                rear[:, t] = soft(move + (scores[:, t + 1] + rear[:, t + 1])[:, None, :], 2)
            total = soft(fore[:, -1] + last, 1)
            want = np.eye(size)[y]
            gap = want - np.exp(fore + rear - total[:, None, None])
            flat, each = x.reshape(-1), gap.reshape(-1, size)
            for k in range(size):
                grad[0][:, k] += np.bincount(flat, np.repeat(each[:, k], x.shape[2]), _HASHED)
            grad[2] += gap[:, 0].sum(axis=0)
            grad[3] += gap[:, -1].sum(axis=0)
            for t in range(1, length):
                ways = fore[:, t - 1][:, :, None] + move + (scores[:, t] + rear[:, t])[:, None, :] - total[:, None, None]
                grad[1] += (want[:, t - 1][:, :, None] * want[:, t][:, None, :] - np.exp(ways)).sum(axis=0)
        for k in range(4):
            seen[k] += grad[k] ** 2
            w[k] = w[k] + rate * grad[k] / np.sqrt(seen[k])
    return Field(*w)


def _gold(run: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    out = []
    for a, b in run:
        label = 0
        for kind, start, end in spans:
            if start < b and end > a:
                label = 1 + 2 * kind + (start < a)
                break
        out.append(label)
    return out


class _Maker:
    """Made examples: spans of each kind that the patterns miss, and words that only look alike."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, *sizes: int) -> list[str]:
        return ["".join(self.r.choices("0123456789", k=n)) for n in sizes]

    def name(self) -> str:
        return "".join(self.r.choices("abcdefghijklmnopqrstuvwxyz", k=self.r.randint(2, 8)))

    def email(self) -> str:
        at, user = self.r.choice(["(at)", "[at]", "(AT)"]), self.r.choice([self.name(), f"{self.name()}.{self.name()}", f"{self.name()}{self.r.randint(1, 99)}"])
        return f"{user}{at}{self.name()}{self.r.choice(['', *self.digits(1)])}.{self.r.choice(['com', 'org', 'example.net', 'co.uk'])}"

    def ip(self) -> str:
        groups = ["".join(self.r.choices("0123456789abcdef", k=self.r.randint(1, 4))) for _ in range(self.r.randint(3, 7))]
        return self.r.choice(["2001", "fe80", "fd12"]) + ":" + self.r.choice(["db8:", ""]) + self.r.choice([":", ""]) + ":".join(groups)

    def card(self) -> str:
        while True:
            found = self.r.choice([self.digits(16), self.digits(16), self.digits(4, 4, 4, 4), self.digits(4, 6, 5)])
            if not luhn("".join(found)):
                return self.r.choice([" ", "-"]).join(found)

    def phone(self) -> str:
        area, three, four, seven = self.digits(3, 3, 4, 7)
        return self.r.choice([
            f"{area}-{three}-{four}", f"({area}) {three}-{four}", f"{area}.{three}.{four}", f"0{area} {seven}", f"0{area[:2]}/{seven}", f"0{area}-{seven}",
            f"0049 {area} {seven}", f"1-{area}-{three}-{four}"])

    def neighbours(self) -> list[tuple[str | None, str]]:
        """A phone number that runs into an address, so that the pattern reads too many digits."""
        area, three, four = self.digits(3, 3, 4)
        return [("phone", f"+{self.r.randint(1, 9)} ({area}) {three}-{four}"), ("ip", ".".join(str(self.r.randint(10, 255)) for _ in range(4)))]

    def other(self) -> str:
        a, b, c, d = self.digits(1, 2, 3, 4)
        return self.r.choice([
            f"20{b}-0{self.r.randint(1, 9)}-{self.r.randint(10, 28)}", f"{self.r.randint(10, 28)}.0{a}.20{b}", f"1{self.r.randint(0, 9)}:{b}", f"{a}.0.", f"{a}.{b}", f"v{a}.{b}.{c}",
            f"19{b}", f"{b},{c}.00", f"${b}", f"{a}.", b, c, d, f"{c}-{b}-{d}", f"978-{a}-{b}-{self.r.randint(100000, 999999)}-{a}", f"{b}-{c}", f"{a}rd", f"{b}%", f"ORD-{b}{c}",
            f"B{b}", f"{b}x{b}", f"{b}.{c},{a}.{d}", "".join(self.r.choices("0123456789abcdef", k=self.r.choice([32, 40, 64]))),
            f'"{"".join(self.r.choices("0123456789abcdef", k=40))}"', f"#{d}", f"{a}/{b}", f"{c}{d}", f"{a},{c},{c}"])

    def example(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A text, and its spans as (kind, start, end)."""
        items: list[tuple[str | None, str]] = []
        for _ in range(self.r.randint(1, 4)):
            kind = self.r.choice([None, None, *KINDS, "beside"])
            items += self.neighbours() if kind == "beside" else [(kind, getattr(self, kind)() if kind else self.other())]
            if self.r.random() < 0.5:
                items.append((None, self.name()))
        text, spans = "", []
        for kind, written in items:
            if kind:
                spans.append((KINDS.index(kind), len(text), len(text) + len(written)))
            text += written + self.r.choice(["", "", "", ".", ",", "!!", "$$$"]) + " "
        return text, spans


def made_examples(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A labelled table: texts with what the patterns miss, and the spans of it."""
    maker = _Maker(seed)
    return [maker.example() for _ in range(count)]


def _learned(text: str, spans: list[tuple[int, int, int]], known: bool) -> Iterator[tuple[list[tuple[int, ...]], list[int]]]:
    """Shapes and labels of a text's runs; without ``known``, not of those with numbers that no span explains."""
    for run in runs(text):
        labels = _gold(run, spans)
        if not known and any(not y and sum(c.isdigit() for c in text[a:b]) > 8 for (a, b), y in zip(run, labels)):
            continue
        for at in range(0, min(len(run), RUN_WORDS), TRAIN_RUN):
            yield [shape_features(text[a:b]) for a, b in run[at:at + TRAIN_RUN]], labels[at:at + TRAIN_RUN]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAIN_DOCS, made: int = TRAIN_MADE, seed: int = 8) -> Field:
    """Fit on ``made`` examples and on at most ``limit`` texts with a digit or ``@``, labelled by the patterns."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for t in batch.column(0).to_pylist() for r in _learned(t, base_spans(t), False)]
            yield pa.RecordBatch.from_arrays([
                pa.array([[list(f) for f in x] for x, _ in found], pa.list_(pa.list_(pa.int32()))), pa.array([y for _, y in found], pa.list_(pa.int32()))], ["x", "y"])

    some = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(key).alias("h"))
    chosen = some.select("h").distinct().orderBy("h").limit(limit)
    picked = some.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"]).select("t")
    rows = [([tuple(f) for f in r["x"]], r["y"]) for r in picked.mapInArrow(label, "x array<array<int>>, y array<int>").toArrow().to_pylist()]
    rows = sorted(rows, key=repr) + [r for t, spans in made_examples(made, seed) for r in _learned(t, spans, True)]
    return fit([x for x, _ in rows], [y for _, y in rows])


def _added(text: str, run: list[tuple[int, int]], labels: np.ndarray, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Spans of a run's labels, without signs at their ends, that meet no span of the patterns."""
    at = 0
    while at < len(run):
        if not labels[at]:
            at += 1
            continue
        kind, to = (int(labels[at]) - 1) // 2, at + 1
        while to < len(run) and labels[to] == 2 + 2 * kind:
            to += 1
        start, end = run[at][0], run[to - 1][1]
        while start < end and not (text[start].isalnum() or text[start] in "+(["):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if start < end and not any(a < end and b > start for _, a, b in base):
            yield kind, start, end
        at = to


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, the number of pattern spans of each kind, ``base`` spans and all ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind and start, comma-joined. A
    null or empty text has none. Rows are independent; repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                found = [(row, run) for row, t in enumerate(texts) for run in runs(t)]
                labels = field.decode([[shape_features(texts[row][a:b]) for a, b in run] for row, run in found])
                spans = [list(b) for b in base]
                for (row, run), label in zip(found, labels):
                    if label.any():
                        spans[row] += _added(texts[row], run, label, base[row])
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(map(_written, base), pa.string()), pa.array(map(_written, spans), pa.string())],
                    ["key", *(f"n_{k}" for k in KINDS), "base", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(key, text).mapInArrow(find, f"key {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string")
    return made.withColumnRenamed("key", key)
