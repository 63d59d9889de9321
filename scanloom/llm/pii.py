"""Personal data: exact base patterns, and a linear-chain conditional random field for what they miss.

The field labels words by the shapes of a word and its neighbours (letters, digits, signs, their numbers, whether
digits pass a card's check or fit an address). It is trained from a small labelled table: written lines with marked
spans, and lines of the given documents that the base patterns label. Words without digit and at sign are outside by
construction, so the chain falls apart at them: only the short runs between are decoded, all of a batch at once by
Viterbi in numpy, and the result equals decoding whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Lines of documents that the labelled table takes at most, about, dealt by hash of the id.
DOCUMENT_LINES = 1500
#: Lines of documents from so many code points on are not learned from, which bounds the table in bytes. All are searched.
LINE_CHARS = 2000
#: An added span needs this probability.
CERTAIN = 0.9
OUTSIDE = 0
LABELS = 1 + 2 * len(KINDS)

# --- Base patterns -------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Matches around each at sign: the longest run before it, from where the last match ended."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
            free = host.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of each kind's matches that hold, in order."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        found[0] = emails(text)
    if "." in text:
        found[1] = [m.span() for m in _IP.finditer(text) if octets(m[0])]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found[2].append(m.span())
    if "+" in text:
        found[3] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# --- Words, shapes, labels -----------------------------------------------------------------------------------------

_SPACE_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_NEEDED = re.compile(r"[0-9@]")


class _Kinds(dict):
    def __missing__(self, point: int) -> str:
        return chr(point) if point < 0x7F else "u"


_KIND_OF = _Kinds({ord(c): "9" for c in "0123456789"} | {ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_REPEATED = re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """Letters as a or A, digits as 9, other ASCII signs as they are, the rest as u; runs once. Of the whole word."""
    return _REPEATED.sub(r"\1", word.translate(_KIND_OF))


def features(words: list[str], before: str, after: str) -> list[list[str]]:
    """Feature names of each word of a run, with the plain words on either side."""
    shapes = [shape(w) for w in words]
    sides = ["<" + before.lower(), *shapes, ">" + after.lower()]
    whole = _digits("".join(words))
    out = []
    for i, word in enumerate(words):
        digits = _digits(word)
        core = word.strip(".,;:!?\"'()[]<>*$%&#|")
        some = [
            "shape " + shapes[i],
            f"digits {min(len(digits), 20)}",
            "before " + sides[i],
            "after " + sides[i + 2],
            f"run {min(len(whole), 20)} of {min(len(words), 6)}",
            f"first {i == 0} last {i == len(words) - 1}",
        ]
        if 16 <= len(digits) <= 19:
            some.append(f"check {luhn(digits)}")
        if 16 <= len(whole) <= 19:
            some.append(f"check of run {luhn(whole)}")
        if core.count(".") == 3 and core.replace(".", "").isdigit():
            some.append(f"address {octets(core) if core.isascii() and all(core.split('.')) else False}")
        if "@" in core:
            left, _, right = core.partition("@")
            some.append(f"at {bool(left)} {bool(right)} {'.' in right}")
        out.append(some)
    return out


@dataclass
class Run:
    """Words with a digit or an at sign, one after another."""

    words: list[str]
    spans: list[tuple[int, int]]
    before: str
    after: str


def runs(text: str) -> list[Run]:
    out: list[Run] = []
    if not _NEEDED.search(text):
        return out
    last, open_run = "", None
    for m in _SPACE_SPLIT.finditer(text):
        word = m[0]
        if _NEEDED.search(word):
            if open_run is None:
                open_run = Run([], [], last, "")
                out.append(open_run)
            open_run.words.append(word)
            open_run.spans.append(m.span())
        elif open_run is not None:
            open_run.after, open_run = word, None
        last = word
    return out


def labels_of(run: Run, spans: list[list[tuple[int, int]]]) -> list[int]:
    """Label of each word by the spans that overlap it; a kind's number, first or further word."""
    out, previous = [], None
    for low, high in run.spans:
        label, here = OUTSIDE, None
        for kind, some in enumerate(spans):
            for a, b in some:
                if a < high and low < b:
                    here = (kind, a)
                    label = 1 + 2 * kind + (here == previous)
        out.append(label)
        previous = here
    return out


# --- The field -----------------------------------------------------------------------------------------------------


@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray  # feature, label
    moves: np.ndarray  # label, next label
    start: np.ndarray


def _emissions(names: dict[str, int], weights: np.ndarray, some: list[list[list[str]]], longest: int) -> tuple[np.ndarray, np.ndarray]:
    scores = np.zeros((len(some), longest, LABELS))
    lengths = np.array([len(r) for r in some])
    for i, run in enumerate(some):
        for t, named in enumerate(run):
            at = [names[n] for n in named if n in names]
            if at:
                scores[i, t] = weights[at].sum(axis=0)
    return scores, lengths


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-partition, label probabilities and summed pair probabilities, by forward and backward sums."""
    n, longest, _ = scores.shape
    forward = np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + start
    for t in range(1, longest):
        after = _logsum(forward[:, t - 1, :, None] + moves, 1) + scores[:, t]
        forward[:, t] = np.where((t < lengths)[:, None], after, forward[:, t - 1])
    total = _logsum(forward[:, -1], 1)
    backward = np.zeros_like(scores)
    pairs = np.zeros_like(moves)
    for t in range(longest - 2, -1, -1):
        inside = (t + 1 < lengths)[:, None]
        step = moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
        backward[:, t] = np.where(inside, _logsum(step, 2), 0)
        joint = np.exp(np.minimum(forward[:, t, :, None] + step - total[:, None, None], 0))
        pairs += (joint * inside[:, :, None]).sum(axis=0)
    chance = np.exp(np.minimum(forward + backward - total[:, None, None], 0))
    chance *= (np.arange(longest) < lengths[:, None])[:, :, None]
    return total, chance, pairs


def best_path(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Viterbi over all runs at once."""
    n, longest, _ = scores.shape
    best, back = scores[:, 0] + start, np.zeros(scores.shape, np.int8)
    for t in range(1, longest):
        step = best[:, :, None] + moves
        inside = (t < lengths)[:, None]
        back[:, t] = np.where(inside, step.argmax(axis=1), np.arange(LABELS))
        best = np.where(inside, step.max(axis=1) + scores[:, t], best)
    path = np.zeros((n, longest), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path


def trained(runs_and_labels: list[tuple[Run, list[int]]], steps: int = 120, penalty: float = 0.01) -> Field:
    """Maximum likelihood by Adam over the whole table, which is small; long runs are cut into pieces of 12 words."""
    pieces = []
    for run, labels in runs_and_labels:
        named = features(run.words, run.before, run.after)
        pieces += [(named[i : i + 12], labels[i : i + 12]) for i in range(0, len(named), 12)]
    names: dict[str, int] = {}
    for named, _ in pieces:
        for some in named:
            for n in some:
                names.setdefault(n, len(names))
    weights, moves, start = np.zeros((len(names), LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)
    # A further word follows a word of its kind only.
    for k in range(len(KINDS)):
        start[2 + 2 * k] = -20
        moves[[a for a in range(LABELS) if a not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -20
    if not pieces:
        return Field(names, weights, moves, start)
    longest = max(len(p) for p, _ in pieces)
    place, word, at = (np.array(x) for x in zip(*[(i, t, names[n]) for i, (p, _) in enumerate(pieces) for t, some in enumerate(p) for n in some], strict=True))
    gold = np.zeros((len(pieces), longest, LABELS))
    gold_moves, gold_start = np.zeros_like(moves), np.zeros_like(start)
    for i, (_, labels) in enumerate(pieces):
        gold[i, np.arange(len(labels)), labels] = 1
        gold_start[labels[0]] += 1
        for a, b in zip(labels, labels[1:], strict=False):
            gold_moves[a, b] += 1
    lengths = np.array([len(p) for p, _ in pieces])
    state = [(w, np.zeros_like(w), np.zeros_like(w)) for w in (weights, moves, start)]
    for step in range(1, steps + 1):
        scores = np.zeros((len(pieces), longest, LABELS))
        np.add.at(scores, (place, word), weights[at])
        _, chance, pairs = marginals(scores, lengths, moves, start)
        slope = np.zeros_like(weights)
        np.add.at(slope, at, (chance - gold)[place, word])
        slopes = (slope + penalty * weights, pairs - gold_moves + penalty * moves * (moves > -20), chance[:, 0].sum(axis=0) - gold_start)
        for (w, m, v), g in zip(state, slopes, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return Field(names, weights, moves, start)


# --- The labelled table --------------------------------------------------------------------------------------------

#: Written lines; a span is [kind:text].
WRITTEN_LINES = (
    "Write to [email:anna.k@post.example.org] before noon.",
    "Contact: [email:m_lopez+news@mail.example.com], or the desk.",
    "Mail [email:jürgen@büro.example.de] for details.",
    "My address is [email:root@localhost] on that machine.",
    "Send it to <[email:info@shop.example.net]> today.",
    "Call [phone:+49 (30) 555-2211] after six.",
    "Phone: [phone:+1 (212) 555-0175] or by letter.",
    "Tel. [phone:+33 1 55 55 01 02] each morning.",
    "Fax [phone:+44.20.5550.1234] is off.",
    "You can phone [phone:(212) 555-0142] at night.",
    "Phone: [phone:212-555-0190] now.",
    "Call me at [phone:030 5550 1188] please.",
    "The host [ip:10.20.30.40] answered.",
    "From [ip:192.0.2.17], a request came.",
    "Server [ip:203.0.113.250] is down.",
    "Paid with [card:4111 1111 1111 1111] yesterday.",
    "Card number [card:5500-0000-0000-0004] was used.",
    "It was [card:4012888888881881] again.",
    "Card [card:4111.1111.1111.1111] is void.",
    "In 2019 there were 4500 of them.",
    "Chapter 12, pages 340-377, has more.",
    "Version 1.2.3 replaced 1.2.2 in May.",
    "Version 10.4.300.2 of it.",
    "Order 1234567890123456 was shipped.",
    "The total was 12,500.50 in all.",
    "On 2021-04-05 at 10:30 it rained.",
    "See RFC 2119 and ISO 8601.",
    "About 20 of 100 agreed; 3 did not.",
    "Copyright 2015-2020 by the writers.",
    "token = \"90ab38b7daa1\" and key 77aa1.",
    "Meet @ 5 near gate 7.",
    "follow @someone there",
    "x@ and @y are signs",
    "ratio 3:2, or 1.5 to 1",
    "Isbn 978-3-16-148410-0 is a book.",
)
_MARK = re.compile(r"\[(email|ip|card|phone):([^\]]*)\]")


def written_table() -> list[tuple[Run, list[int]]]:
    out = []
    for line in WRITTEN_LINES:
        text, spans, last = "", [[] for _ in KINDS], 0
        for m in _MARK.finditer(line):
            text += line[last : m.start()]
            spans[KINDS.index(m[1])].append((len(text), len(text) + len(m[2])))
            text += m[2]
            last = m.end()
        text += line[last:]
        out += [(run, labels_of(run, spans)) for run in runs(text)]
    return out


def labelled_lines(docs: DataFrame, lines: int = DOCUMENT_LINES) -> list[str]:
    """About so many lines with a digit or an at sign, and no more than twice as many, from all of ``docs``.

    Documents are dealt by hash of id and text, equal lines count once, and lines of ``LINE_CHARS`` and more are left out.
    """
    some = docs.where(F.col("text").rlike("[0-9@]"))
    count = max(1, some.count())
    share = int(min(1.0, lines / count) * 1_000_000)
    dealt = some.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share).select(F.explode(F.split("text", "\n")).alias("line"))
    dealt = dealt.where(F.col("line").rlike("[0-9@]") & (F.length("line") < LINE_CHARS)).distinct()
    return [r.line for r in dealt.orderBy(F.xxhash64("line"), "line").limit(2 * lines).collect()]


def learned(docs: DataFrame) -> Field:
    table_of = written_table() * 3
    for line in labelled_lines(docs):
        spans = base_spans(line)
        table_of += [(run, labels_of(run, spans)) for run in runs(line)]
    return trained(table_of)


# --- Finding -------------------------------------------------------------------------------------------------------

_TRIM = ".,;:!?\"'<>[]*$%&#|="


def _holds(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 0:
        left, _, right = text.partition("@")
        return bool(left) and len(right) > 1 and "@" not in right
    if kind == 1:
        return text.isascii() and text.count(".") == 3 and all(text.split(".")) and text.replace(".", "").isdigit() and octets(text)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and not re.search(r"[^0-9+()\x20./-]", text)


def added_spans(text_runs: list[tuple[int, Run]], texts: list[str], base: list[list[list[tuple[int, int]]]], field: Field) -> list[list[list[tuple[int, int]]]]:
    """Further spans of each text, from runs decoded together; those that touch a base span are left out."""
    out: list[list[list[tuple[int, int]]]] = [[[] for _ in KINDS] for _ in texts]
    order = sorted(range(len(text_runs)), key=lambda i: len(text_runs[i][1].words))
    low = 0
    while low < len(order):
        # Runs of like length together; a very long run stands alone.
        high, longest = low, 1
        while high < len(order) and high - low < 512:
            length = len(text_runs[order[high]][1].words)
            if high > low and length * (high - low + 1) > 20_000:
                break
            longest, high = length, high + 1
        some = [text_runs[i] for i in order[low:high]]
        low = high
        named = [features(r.words, r.before, r.after) for _, r in some]
        scores, lengths = _emissions(field.names, field.weights, named, longest)
        path = best_path(scores, lengths, field.moves, field.start)
        _, chance, _ = marginals(scores, lengths, field.moves, field.start)
        for k, (i, run) in enumerate(some):
            t = 0
            while t < len(run.words):
                label = int(path[k, t])
                first, sure = t, chance[k, t, label]
                t += 1
                if label == OUTSIDE:
                    continue
                while t < len(run.words) and path[k, t] == 2 + 2 * ((label - 1) // 2):
                    sure = min(sure, chance[k, t, int(path[k, t])])
                    t += 1
                kind = (label - 1) // 2
                a, b = run.spans[first][0], run.spans[t - 1][1]
                while a < b and texts[i][a] in _TRIM:
                    a += 1
                while a < b and texts[i][b - 1] in _TRIM:
                    b -= 1
                if sure < CERTAIN or a >= b or not _holds(kind, texts[i][a:b]):
                    continue
                if not any(x < b and a < y for spans in base[i] for x, y in spans):
                    out[i][kind].append((a, b))
    return out


def digest(spans: Iterable[Iterable[tuple[int, int]]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, some in enumerate(spans) for a, b in sorted(some))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def found(docs: DataFrame, field: Field) -> DataFrame:
    """Personal data of each row of ``docs`` (doc_id, text, ...): numbers of base spans, their digest, all spans.

    A null text is empty: no spans and the digest of nothing. Offsets are code points. Texts of any length are searched
    whole, however long their lines and words. Repeated rows and null ids have a row each; an empty table gives an empty one;
    where spans of one kind tie for a place, the leftmost holds. Other columns, whatever their names, are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                some = [bool(_NEEDED.search(t)) for t in texts]
                base = [base_spans(t) if s else [[], [], [], []] for t, s in zip(texts, some, strict=True)]
                text_runs = [(i, r) for i, (t, s) in enumerate(zip(texts, some, strict=True)) if s for r in runs(t)]
                more = added_spans(text_runs, texts, base, field)
                counts = [pa.array([len(b[k]) for b in base], pa.int64()) for k in range(len(KINDS))]
                shas = [hashlib.sha256(digest(b).encode()).hexdigest() for b in base]
                spans = [digest([x + y for x, y in zip(b, m, strict=True)]) for b, m in zip(base, more, strict=True)]
                columns = [part.column(0), *counts, pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array([sum(map(len, m)) for m in more], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return found(docs, learned(docs))


QUERIES = {"op8_pii": op8_pii}
