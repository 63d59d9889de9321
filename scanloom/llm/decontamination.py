"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as lower-cased letters and digits, with one gap between words. A benchmark item is searched as
pieces that begin every few characters, so that a passage is found wherever it was cut. A region of a document within
``k`` edits of a piece with ``g`` q-grams, taken at every third character, shares at least ``g - k q / 3`` of them inside
a band of ``k + 1`` diagonals (place in the text less place in the piece), as an edit spoils q / 3 at most. So shared q-grams are counted in bands of twice that
width, half overlapping; only bands that meet the bound go on, and an alignment within the band decides. A first count
by item and band, in hashed slots, leaves most hits out.

Items too short for a piece are searched as they are, between word borders: hashes of all runs of an item's length that
begin with a word are looked up, and the characters compared.

The benchmark is taken in blocks of bounded size; a pass over all documents meets ``PASS_BLOCKS`` blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import buckets_for, mixed, powers, slices, small_batches, table

Q = 6
#: An item's q-grams are indexed at every third character; a text's are taken everywhere.
EVERY = 3
#: A passage of PIECE + STRIDE - 1 characters holds a whole piece, wherever it begins.
PIECE = 72
STRIDE = 9
#: A piece may have one edit for so many of its characters: a replaced word or two.
CHARACTERS_AN_EDIT = 8
#: Items with fewer characters (letters, digits, gaps) than this are searched without edits.
LEAST_ITEM = 32
#: Items with fewer than this are no reason to drop a document: any text may hold such a word.
LEAST_REASON = 12
BLOCK_CHARACTERS = 128_000
#: Blocks of one pass: an index of about 2 MB of benchmark, some 100 MB in a worker.
PASS_BLOCKS = 16
BITS = 22
#: Places of texts whose hits are counted at once, and slots they are counted in.
CHUNK = 1 << 17
SLOTS = 1 << 20
_OUTSIDE = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Letters and digits of the basic plane in lower case, 0 for all else."""
    codes = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalnum():
            low = chr(c).lower()
            codes[c] = ord(low) if len(low) == 1 else c
    return codes


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal characters of all texts, where each text's begin, and each character's place in its text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = _folded()[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        plain = np.where(points > 0xFFFF, points, plain)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    solid = plain > 0
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    first = np.zeros(len(points) + 1, bool)
    first[begin] = True
    keep &= solid | ~first[:-1]
    at = np.flatnonzero(keep)
    bounds = np.searchsorted(at, begin)
    return plain[at], bounds, at - np.repeat(begin[:-1], np.diff(bounds))


def qgrams(chars: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``Q`` characters, by joining runs of doubled length."""
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = lambda n: np.uint64(pow(int(base), n, 1 << 64))
    one = chars.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * base + one[1:]
    four = two[:-2] * power(2) + two[2:]
    return mixed(four[: len(chars) - Q + 1] * power(2) + two[4 : len(chars) - Q + 5])


@dataclass
class Pieces:
    """Pieces of a block of items and an index of the items' q-grams."""

    items: np.ndarray  # number of the item of each piece
    ids: list
    lengths: np.ndarray
    starts: np.ndarray  # where in its item a piece begins
    chars: np.ndarray  # piece, character; outside behind its end
    grams: np.ndarray  # sorted
    first: np.ndarray  # where a q-gram's places begin
    item: np.ndarray
    offset: np.ndarray
    seen: np.ndarray  # bits of hashes that occur
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes, items, characters

    @property
    def edits(self) -> np.ndarray:
        return self.lengths // CHARACTERS_AN_EDIT

    @property
    def least(self) -> np.ndarray:
        """Q-grams that a region within the edits must share."""
        grams = (self.starts + self.lengths - Q) // EVERY - -(-self.starts // EVERY) + 1
        return np.maximum(grams - self.edits * (Q // EVERY), 1)


def indexed(items: list[tuple[object, str | None]]) -> Pieces:
    owner, parts, begins, ids, hashes, searched, short = [], [], [], [], [], [], []
    for number, (item, text) in enumerate(items):
        ids.append(item)
        chars, _, _ = normal([text or ""])
        if len(chars) and chars[-1] == 0:
            chars = chars[:-1]
        if len(chars) < LEAST_ITEM:
            if len(chars):
                short.append((number, chars))
            continue
        starts = list(range(0, max(1, len(chars) - PIECE + 1), STRIDE))
        if len(chars) > PIECE and starts[-1] != len(chars) - PIECE:
            starts.append(len(chars) - PIECE)
        for s in starts:
            owner.append(number)
            begins.append(s)
            parts.append(chars[s : s + PIECE])
        hashes.append(qgrams(chars)[::EVERY])
        searched.append(number)
    grid = np.full((len(parts), PIECE), _OUTSIDE, np.uint32)
    for i, part in enumerate(parts):
        grid[i, : len(part)] = part
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.repeat(searched, [len(h) for h in hashes]).astype(np.int64) if hashes else np.zeros(0, np.int64)
    offset = np.concatenate([np.arange(len(h)) * EVERY for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << BITS, bool)
    seen[(grams >> np.uint64(64 - BITS)).astype(np.int64)] = True
    lengths = np.array([len(p) for p in parts], np.int64)
    return Pieces(np.array(owner, np.int64), ids, lengths, np.array(begins, np.int64), grid, grams, np.append(first, len(every)), item[order], offset[order], seen, _short_items(short))


def _run_hashes(chars: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` characters that begin at these places."""
    up, down = powers(len(chars) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], dtype=np.uint64)))
    return mixed((total[at + length] - total[at]) * down[at])


def _short_items(items: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = {}
    for length in sorted({len(c) for _, c in items}):
        mine = [(number, c) for number, c in items if len(c) == length]
        grid = np.stack([c for _, c in mine])
        hashes = np.array([_run_hashes(c, np.zeros(1, np.int64), length)[0] for c in grid], np.uint64)
        order = np.argsort(hashes, kind="stable")
        out[length] = hashes[order], np.array([number for number, _ in mine])[order], grid[order]
    return out


def _short_found(pieces: Pieces, chars: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, first, behind last, -1 for no piece, 0) wherever a short item stands between borders of words."""
    word = chars > 0
    edge = np.zeros(len(chars) + 1, bool)
    edge[begin] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    found = []
    for length, (hashes, items, grid) in pieces.short.items():
        at = starts[starts + length <= len(chars)]
        text = np.searchsorted(begin, at, side="right") - 1
        inside = at + length <= begin[text + 1]
        behind = at + length
        closed = edge[behind] | ~np.concatenate((word, [False]))[behind]
        at, text = at[inside & closed], text[inside & closed]
        run = _run_hashes(chars, at, length)
        low, high = np.searchsorted(hashes, run, side="left"), np.searchsorted(hashes, run, side="right")
        for k in np.flatnonzero(high > low).tolist():
            place = int(at[k])
            for i in range(int(low[k]), int(high[k])):
                if (grid[i] == chars[place : place + length]).all():
                    found.append((int(text[k]), int(items[i]), place, place + length, -1, 0))
    return found


def aligned(pieces: Pieces, which: np.ndarray, chars: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits, first and behind-last place of each piece in a text between low and high, near a diagonal.

    One row of the alignment a step, for all candidates at once; a cell holds edits and, below, where it began. The
    alignment may begin and end anywhere within the band.
    """
    lengths, edits = pieces.lengths[which], pieces.edits[which]
    width = int(2 * (edits.max() + 1) + 2 * edits.max() + 1)
    base = diagonal - edits
    across = np.arange(width)
    edit = 1 << 20
    cells = np.tile(across, (len(which), 1)).astype(np.int64)
    far = np.int64(1) << 40
    for i in range(int(lengths.max())):
        at = base[:, None] + i + across
        inside = (at >= low[:, None]) & (at < high[:, None])
        text = np.where(inside, chars[np.clip(at, 0, len(chars) - 1)], _OUTSIDE)
        same = text == pieces.chars[which, i][:, None]
        over = cells + np.where(same, 0, np.where(inside, edit, far))
        gone = np.concatenate((cells[:, 1:] + edit, np.full((len(which), 1), far)), axis=1)
        after = np.minimum(over, gone)
        after = np.minimum.accumulate(after - across * edit, axis=1) + across * edit
        cells = np.where((i < lengths)[:, None], after, cells)
    best = cells.argmin(axis=1)
    value = cells[np.arange(len(which)), best]
    return value >> 20, base + (value & (edit - 1)), base + lengths + best


def _several(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... (count of them) of each row, one after the other."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def _candidates(pieces: Pieces, hashes: np.ndarray, begin: np.ndarray, low: int, high: int, size: int) -> np.ndarray:
    """Text, piece and band (rows) wherever enough q-grams between two places are shared."""
    maybe = low + np.flatnonzero(pieces.seen[(hashes[low:high] >> np.uint64(64 - BITS)).astype(np.int64)])
    gram = np.minimum(np.searchsorted(pieces.grams, hashes[maybe]), len(pieces.grams) - 1)
    hit = pieces.grams[gram] == hashes[maybe]
    at, gram = maybe[hit], gram[hit]
    text = np.searchsorted(begin, at, side="right") - 1
    whole = at + Q <= begin[text + 1]
    at, gram, text = at[whole], gram[whole], text[whole]
    if not len(at):
        return np.zeros((3, 0), np.int64)
    count = pieces.first[gram + 1] - pieces.first[gram]
    place = _several(pieces.first[gram], count)
    item, at = pieces.item[place], np.repeat(at, count)
    # Hits by item and band, wide enough for every piece; of neighbours that share a slot, too many go on, never too few.
    need = np.full(len(pieces.ids), PIECE, np.int64)
    np.minimum.at(need, pieces.items, pieces.least)
    step = int(pieces.edits.max()) + 1
    band = (at - pieces.offset[place]) // step
    slot = (item * ((high - low) // step + size // step + 3) + band) % SLOTS
    held = np.bincount(slot, minlength=SLOTS)
    pair = held + np.roll(held, -1)
    left = np.flatnonzero(np.maximum(pair, np.roll(pair, 1))[slot] >= need[item])
    place, item, at, text = place[left], item[left], at[left], np.repeat(text, count)[left]
    # Each hit that is left, for every piece that has it.
    offset, name = pieces.offset[place], pieces.items * size + pieces.starts
    one = np.searchsorted(name, item * size + np.maximum(offset - (PIECE - Q), 0))
    count = np.searchsorted(name, item * size + offset, side="right") - one
    piece = _several(one, count)
    at, text, diagonal = np.repeat(at, count), np.repeat(text, count), np.repeat(at - offset, count) + pieces.starts[piece]
    band = diagonal // (pieces.edits[piece] + 1)
    # Each hit counts in its band and in the one before, which overlaps half of it.
    at, offset = np.tile(at, 2), np.tile(at - diagonal, 2)
    text, piece, band = np.tile(text, 2), np.tile(piece, 2), np.concatenate((band, band - 1))
    key = (text * len(pieces.lengths) + piece) * (begin[-1] + 4 * PIECE) + band + 2 * PIECE
    source = np.arange(len(key))
    # Shared q-grams have places of their own in the piece and in the text: "the the the" counts by the fewer.
    for where in (offset, at):
        order = source[np.lexsort((where[source], key[source]))]
        name, spot = key[order], where[order]
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (spot[1:] != spot[:-1])
        _, group, count = np.unique(name[fresh], return_inverse=True, return_counts=True)
        group = np.repeat(group, np.diff(np.append(np.flatnonzero(fresh), len(name))))
        source = order[count[group] >= pieces.least[piece[order]]] if len(order) else order
    _, first = np.unique(key[source], return_index=True)
    return np.stack((text, piece, band))[:, source[first]]


@dataclass
class Prepared:
    """Normal characters and q-grams of some texts, for any number of blocks."""

    chars: np.ndarray
    begin: np.ndarray
    origin: np.ndarray
    hashes: np.ndarray


def prepared(texts: list[str]) -> Prepared:
    chars, begin, origin = normal(texts)
    return Prepared(chars, begin, origin, qgrams(chars))


def leaks(texts: list[str] | Prepared, pieces: Pieces) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, first, behind last, pieces, edits) of each region that holds an item or pieces of it.

    Places are code points of the text; pieces of an item that overlap or touch make one region, so do short items, which
    have no pieces and no edits.
    """
    held = texts if isinstance(texts, Prepared) else prepared(texts)
    found = _pieces_found(pieces, held.chars, held.hashes, held.begin) if len(pieces.lengths) else []
    found += _short_found(pieces, held.chars, held.begin) if pieces.short else []
    origin = held.origin
    return [(t, item, int(origin[s]), int(origin[e - 1]) + 1, len(ps - {-1}), d) for t, item, s, e, ps, d in _regions(found)]


def _regions(found: list[tuple]) -> list[list]:
    out: list[list] = []
    for t, item, s, e, p, d in sorted(found):
        if out and out[-1][0] == t and out[-1][1] == item and s <= out[-1][3]:
            out[-1][3] = max(out[-1][3], e)
            out[-1][4].add(p)
            out[-1][5] = min(out[-1][5], d)
        else:
            out.append([t, item, s, e, {p}, d])
    return out


def _pieces_found(pieces: Pieces, chars: np.ndarray, hashes: np.ndarray, begin: np.ndarray) -> list[tuple]:
    """(text, item, first, behind last, piece, edits) of each aligned piece, in places of ``chars``."""
    size = int(pieces.offset.max()) + PIECE
    # Chunks overlap by more than a region, so that each region lies inside one.
    over = PIECE + 2 * int(pieces.edits.max()) + Q
    some = [_candidates(pieces, hashes, begin, low, min(len(hashes), low + CHUNK + over), size) for low in range(0, len(hashes), CHUNK)]
    if not some:
        return []
    text, piece, band = np.unique(np.concatenate(some, axis=1), axis=1) if len(some) > 1 else some[0]
    found = []
    for low in range(0, len(text), 4096):
        t, p, b = text[low : low + 4096], piece[low : low + 4096], band[low : low + 4096]
        edits, start, end = aligned(pieces, p, chars, begin[t], begin[t + 1], b * (pieces.edits[p] + 1))
        for k in np.flatnonzero(edits <= pieces.edits[p]).tolist():
            s, e = max(int(start[k]), int(begin[t[k]])), min(int(end[k]), int(begin[t[k] + 1]))
            if e > s:
                found.append((int(t[k]), int(pieces.items[p[k]]), s, e, int(p[k]), int(edits[k])))
    return found


def benchmark_blocks(benchmark: DataFrame, characters: int = BLOCK_CHARACTERS) -> Iterator[Pieces]:
    """The benchmark's (item_id, text) in blocks of about so many characters, dealt by hash."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = buckets_for(total, characters)
    for block in range(blocks):
        some = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        yield indexed(sorted(((r.item_id, r.text) for r in some), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))


def _passes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of the benchmark, ``PASS_BLOCKS`` blocks each: one for each pass over the documents."""
    blocks = benchmark_blocks(benchmark)
    while some := list(islice(blocks, PASS_BLOCKS)):
        yield docs.sparkSession.sparkContext.broadcast(some)


def _in_slices(column: pa.Array, blocks: list[Pieces]) -> Iterator[tuple[int, list]]:
    texts = [t or "" for t in column.to_pylist()]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for low, high in slices(offsets, 1 << 18):
        held = prepared(texts[low:high])
        yield low, [(t, pieces.ids[item], *rest) for pieces in blocks for t, item, *rest in leaks(held, pieces)]


_LEAK = "doc_id long, item_id long, start long, end long, pieces int, edits int"


def leaked_regions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Regions of ``docs`` (doc_id, text, ...) that hold benchmark text: a row for each document, item and region.

    Items of any length count; those below ``LEAST_ITEM`` characters as they are, between borders of words, with 0
    pieces. Clean documents have no row, nor have null and empty texts or items, nor empty tables; repeated rows and items
    have their rows each; null ids stay. Other columns, whatever their names, are not carried.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in _passes(docs, benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")):

        def run(batches, shared=shared):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[low + t], *rest) for low, some in _in_slices(batch.column(1), shared.value) for t, *rest in some]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "end", "pieces", "edits"])

        found = texts.mapInArrow(run, _LEAK)
        out = found if out is None else out.union(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_REASON) -> DataFrame:
    """``docs`` without the rows that hold benchmark text; null and empty texts stay.

    Items of fewer than ``least`` normal characters are left out: they would take clean documents along.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    for shared in _passes(docs, benchmark):

        def run(batches, shared=shared):
            blocks = [replace(b, short={n: some for n, some in b.short.items() if n >= least}) for b in shared.value]
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for low, some in _in_slices(batch.column(place), blocks):
                    keep[[low + t for t, *_ in some]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
