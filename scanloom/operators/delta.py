"""Ordered line deltas with hunks.

``patch.line_delta`` tells which lines are gone and new as a bag; here lines keep their order, so a moved line is seen. Lines
that occur once on both sides of a file are anchors if they lie on the longest run that rises on both sides; between
anchors the same is done again, and what stands equal at the ends of a gap is paired too. All else was removed or added.
A file's two texts lie in one row and are compared there, so nothing is joined or shuffled for a script; what follows groups
by what one file bounds.
"""

from __future__ import annotations

import sys
from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.text import lines_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE = ["repo", "path"]
CONTEXT = 3
#: How often anchors are looked for: in the file, then between the anchors found.
ROUNDS = 2
_PAIR = pa.struct([("old_no", pa.int32()), ("new_no", pa.int32())])
_ROW = pa.struct([("at", pa.int32()), ("mark", pa.string()), ("old_no", pa.int32()), ("new_no", pa.int32()), ("line", pa.string())])


def _rising(news: list[int]) -> list[int]:
    """Places of the longest rising run of distinct numbers."""
    # ``ends``: the least number that ends a rising run of each length; ``heads``: where it is.
    ends, heads, before = [], [], []
    for place, new in enumerate(news):
        length = bisect_left(ends, new)
        ends[length : length + 1] = [new]
        heads[length : length + 1] = [place]
        before.append(heads[length - 1] if length else -1)
    run, place = [], heads[-1] if heads else -1
    while place >= 0:
        run.append(place)
        place = before[place]
    return run[::-1]


def rising(pairs: Column) -> Column:
    """The longest subsequence of (old_no, new_no), sorted by old_no, in which new_no rises too."""

    @F.arrow_udf("array<struct<old_no:int,new_no:int>>")
    def longest(held: pa.Array) -> pa.Array:
        rows = [row and [row[i] for i in _rising([p["new_no"] for p in row])] for row in held.to_pylist()]
        return pa.array(rows, pa.list_(_PAIR))

    return longest(pairs)


def _gaps(pairs: list[tuple[int, int]], n_old: int, n_new: int):
    """Ranges of lines on both sides that lie between pairs, none of them empty."""
    at_old = at_new = 0
    for old, new in [*pairs, (n_old, n_new)]:
        if old > at_old and new > at_new:
            yield at_old, old, at_new, new
        at_old, at_new = old + 1, new + 1


def _single(lines: list[int], low: int, high: int) -> dict[int, int]:
    """Where the lines are that occur once in a range."""
    places = {}
    for i in range(low, high):
        places[lines[i]] = -1 if lines[i] in places else i
    return {line: i for line, i in places.items() if i >= 0}


def _pairs(old: list[int], new: list[int], rounds: int) -> list[tuple[int, int]]:
    """Places on both sides of the lines that stay, both rising. Lines are numbers, equal where they are."""
    pairs = []
    for _ in range(rounds):
        found = []
        for low, high, new_low, new_high in _gaps(pairs, len(old), len(new)):
            there = _single(new, new_low, new_high)
            both = [(i, there[line]) for line, i in _single(old, low, high).items() if line in there]
            found += [both[i] for i in _rising([j for _, j in both])]
        pairs = sorted(pairs + found)
    found = []
    for low, high, new_low, new_high in _gaps(pairs, len(old), len(new)):
        while low < high and new_low < new_high and old[low] == new[new_low]:
            found.append((low, new_low))
            low, new_low = low + 1, new_low + 1
        while low < high and new_low < new_high and old[high - 1] == new[new_high - 1]:
            high, new_high = high - 1, new_high - 1
            found.append((high, new_high))
    return sorted(pairs + found)


def _script_udf(rounds: int):
    @F.arrow_udf("array<struct<at:int,mark:string,old_no:int,new_no:int,line:string>>")
    def script(olds: pa.Array, news: pa.Array) -> pa.Array:
        held = pa.concat_arrays([olds.flatten(), news.flatten()])
        codes = pc.dictionary_encode(held).indices.to_numpy()
        offsets, ats, marks, old_nos, new_nos, taken = [0], [], [], [], [], []
        first, new_first = 0, len(olds.flatten())
        for n_old, n_new in zip(pc.list_value_length(olds).to_pylist(), pc.list_value_length(news).to_pylist(), strict=True):
            pairs = _pairs(codes[first : first + n_old].tolist(), codes[new_first : new_first + n_new].tolist(), rounds)
            low = new_low = 0
            for old, new in [*pairs, (n_old, n_new)]:
                removed, added = range(low, old), range(new_low, new)
                marks += ["-"] * len(removed) + ["+"] * len(added)
                old_nos += [*(i + 1 for i in removed), *(None for _ in added)]
                new_nos += [*(None for _ in removed), *(i + 1 for i in added)]
                taken += [*(first + i for i in removed), *(new_first + i for i in added)]
                if old < n_old:
                    marks.append(" ")
                    old_nos.append(old + 1)
                    new_nos.append(new + 1)
                    taken.append(first + old)
                low, new_low = old + 1, new + 1
            ats += range(1, len(marks) - offsets[-1] + 1)
            offsets.append(len(marks))
            first, new_first = first + n_old, new_first + n_new
        lines = held.take(pa.array(taken, pa.int64()))
        columns = [pa.array(ats, pa.int32()), pa.array(marks, pa.string()), pa.array(old_nos, pa.int32()), pa.array(new_nos, pa.int32()), lines]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_ROW)))

    return script


def line_scripts(changed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(repo, path, script): ``line_script`` as one array a file, in the order of ``at``; empty without any line on both sides."""

    def lines(text: str) -> Column:
        return F.when(F.length(text) > 0, lines_of(F.col(text))).otherwise(F.array().cast("array<string>"))

    return changed.select(*FILE, _script_udf(rounds)(lines("old_text"), lines("new_text")).alias("script"))


def script_text(script: Column, mark: str) -> Column:
    """The old text (``-``) or the new one (``+``) from the script of ``line_scripts``, in the row."""
    return F.array_join(F.transform(F.filter(script, lambda r: r["mark"].isin(" ", mark)), lambda r: r["line"]), "\n")


def line_script(changed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(repo, path, at, mark, old_no, new_no, line): how the old text of each file becomes the new one.

    ``changed`` comes from ``patch.changed_files`` or ``patch.text_pairs``. Marks are ``-``, ``+`` and a blank; the
    lines with ``-`` or a blank are the old text in order, those with ``+`` or a blank the new one. Of a changed
    place removed lines come first. Files without any line on both sides have no row.
    """
    # Not ``inline``: Spark would compare twice, first to leave out files without a row.
    return line_scripts(changed, rounds).select(*FILE, F.inline_outer("script")).where("at IS NOT NULL")


def hunks(script: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Changed lines with up to ``context`` lines around them, and the number of the hunk they make."""
    line = Window.partitionBy(*FILE).orderBy("at")
    changed = F.when(F.col("mark") != " ", F.col("at"))
    near = script.withColumns(
        {
            "__last": F.max(changed).over(line.rowsBetween(Window.unboundedPreceding, 0)),
            "__next": F.min(changed).over(line.rowsBetween(0, Window.unboundedFollowing)),
            "old_before": F.count("old_no").over(line.rowsBetween(Window.unboundedPreceding, -1)),
            "new_before": F.count("new_no").over(line.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    shown = near.where((F.col("at") - F.col("__last") <= context) | (F.col("__next") - F.col("at") <= context))
    begins = F.coalesce(F.col("at") - F.lag("at").over(line) > 1, F.lit(True)).cast("int")
    numbered = shown.withColumn("__begins", begins).withColumn("hunk", F.sum("__begins").over(line))
    return numbered.select(*FILE, "hunk", "at", "mark", "old_no", "new_no", "line", "old_before", "new_before")


def hunk_headers(shown: DataFrame) -> DataFrame:
    """(repo, path, hunk, old_start, old_count, new_start, new_count, header) of the rows of ``hunks``."""
    counted = shown.groupBy(*FILE, "hunk").agg(
        F.min("old_before").alias("old_before"), F.count("old_no").alias("old_count"),
        F.min("new_before").alias("new_before"), F.count("new_no").alias("new_count"),
    )
    # A side without lines names the line before.
    start = lambda side: (F.col(f"{side}_before") + F.when(F.col(f"{side}_count") > 0, 1).otherwise(0)).alias(f"{side}_start")
    told = counted.select(*FILE, "hunk", start("old"), "old_count", start("new"), "new_count")
    return told.withColumn("header", F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_count", "new_start", "new_count"))


def unified_text(shown: DataFrame) -> DataFrame:
    """The hunks of each file as one text; it is no longer than the file's two texts and headers."""
    row = lambda at, text: F.struct("hunk", at.alias("at"), text.alias("text"))
    lines = shown.select(*FILE, row(F.col("at"), F.concat("mark", "line")).alias("row"))
    heads = hunk_headers(shown).select(*FILE, row(F.lit(0), F.col("header")).alias("row"))
    ordered = F.array_sort(F.collect_list("row"))
    return lines.unionByName(heads).groupBy(*FILE).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("diff"))
