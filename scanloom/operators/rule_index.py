"""Very many own rules: an inverted index from short strings to the rules that need them.

``scan_files`` makes every own pattern a literal of the plan, which suits dozens of rules. Here rules are a table. Of each
pattern a literal is taken that every match must hold, and cut to q-grams; the one that is rarest in the corpus is
the pattern's key. Lines meet patterns where they hold the key, by an equi-join, and the pattern decides. Patterns from which
no literal can be taken keep the way of ``scan_files``. A pattern that many rules share is searched once for all of them.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.text import raw_lines, strip_right
from scanloom.operators.scan import CUSTOM_PASS, scan_files
from scanloom.sources.tables import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Q = 3
#: Slots of the table of hashed q-grams that goes with every task, a byte each.
SLOTS = 1 << 18
_ANCHORS_AND_CLASSES = "bBdDsSwWntrfAZzhHvVRG"
#: Letters that other letters fold to where case is ignored beyond ASCII.
_FOLDED_FROM_AFAR = "iks"


def _behind_group(pattern: str, at: int) -> int | None:
    """The place behind the group or class that begins here; None where it does not end."""
    closing, classes = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern[at + 1 : at + 2] == "Q":
                return None
            at += 1
        elif c == "[":
            if pattern[at + 1 : at + 3].lstrip("^")[:1] == "]":
                return None  # a bracket that may close the class or belong to it
            classes += 1
        elif c == "]" and classes:
            classes -= 1
        elif not classes and c == "(":
            closing.append(c)
        elif not classes and c == ")":
            closing.pop()
        at += 1
        if not classes and not closing:
            return at
    return None


def _behind_quantifier(pattern: str, at: int) -> tuple[int, bool] | None:
    """The place behind a quantifier that begins here, and whether it allows none at all; None where there is none."""
    c = pattern[at : at + 1]
    if c not in ("?", "*", "+", "{") or not c:
        return None
    optional = c in "?*"
    if c == "{":
        end = pattern.find("}", at)
        low = pattern[at + 1 : end].split(",")[0]
        optional = not (end > 0 and low.isdecimal() and int(low) > 0)
        at = end if end > 0 else len(pattern)
    at += 1
    return (at + 1 if pattern[at : at + 1] in ("?", "+") and pattern[at : at + 1] else at), optional


def required_literal(pattern: str | None) -> str | None:
    """A string in lower case that the lower-cased line holds wherever the pattern matches, the longest found.

    Only plain characters outside groups count, and nothing is taken from patterns with alternatives at the top, quoting,
    code points by number or free spacing.
    """
    if not pattern:
        return None
    folds = ""
    if pattern.startswith("(?") and ")" in pattern and pattern[2 : pattern.index(")")].isalpha():
        flags = pattern[2 : pattern.index(")")]
        if "x" in flags:
            return None
        folds = _FOLDED_FROM_AFAR if "i" in flags and ("u" in flags or "U" in flags) else ""
        pattern = pattern[pattern.index(")") + 1 :]
    runs, run, at = [], "", 0
    while at < len(pattern):
        c, literal = pattern[at], ""
        if c == "|" or c in "?*+":
            return None
        if c in "([":
            if pattern[at : at + 2] == "(?" and pattern[at + 2 : at + 3] not in (":", "=", "!", "<", ">"):
                return None  # flags that change from here
            behind = _behind_group(pattern, at)
            if behind is None:
                return None
            at = behind
        elif c == "\\":
            c = pattern[at + 1 : at + 2]
            if not c or (c.isalnum() and c not in _ANCHORS_AND_CLASSES):
                return None
            literal = "" if c.isalnum() else c
            at += 2
        else:
            literal = "" if c in ".^$" else c
            at += 1
        if literal and (not literal.isascii() or literal.lower() in folds):
            literal = ""
        after = _behind_quantifier(pattern, at)
        if after:
            at, optional = after
            runs.append(run + ("" if optional else literal))
            run = ""
        elif literal:
            run += literal
        else:
            runs.append(run)
            run = ""
    best = max([*runs, run], key=len).lower()
    return best if len(best) >= Q else None


def _literals(batches):
    for batch in batches:
        found = [required_literal(p) for p in batch.column("pattern").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "literal"])


def _named(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", "language", "pattern").where("pattern IS NOT NULL AND language IS NOT NULL").distinct()


def _patterns(rules: DataFrame) -> DataFrame:
    """Distinct (language, pattern, literal), the literal null where none can be taken."""
    rows = rules.select("language", "pattern").where("pattern IS NOT NULL AND language IS NOT NULL").distinct()
    return rows.mapInArrow(_literals, "language string, pattern string, literal string")


def rules_with_literals(rules: DataFrame) -> DataFrame:
    """Distinct (rule_id, language, pattern) with the literal each needs, null where none can be taken."""
    return _named(rules).join(_patterns(rules), ["language", "pattern"]).select("rule_id", "language", "pattern", "literal")


def q_grams(text: Column) -> Column:
    """Distinct runs of ``Q`` characters of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=({'.' * Q}))"), F.lit(1)))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def _among(grams: DataFrame):
    """A test of whether a q-gram can be among these: a byte for each slot, so its size is fixed."""
    held = bytearray(SLOTS)
    for row in grams.select(_slot(F.col("gram")).alias("slot")).distinct().collect():
        held[row.slot] = 1
    table = F.lit(bytes(held))
    return lambda gram: F.substring(table, _slot(gram) + 1, F.lit(1)) == F.lit(b"\x01")


def _lines(source_files: DataFrame) -> DataFrame:
    held = source_files.where(F.col("text").isNotNull() & F.col("language").isNotNull())
    lines = held.select("repo", "path", "language", F.posexplode(raw_lines(F.col("text"))).alias("at", "line"))
    return lines.select("repo", "path", "language", (F.col("at") + 1).cast("int").alias("line_no"), "line")


def _line_grams(lines: DataFrame, among) -> DataFrame:
    """Lines once for each of their q-grams that pass; others are left out before anything is multiplied."""
    return lines.select("*", F.explode(F.filter(q_grams(F.col("line")), among)).alias("gram"))


def _gram_counts(source_files: DataFrame, patterns: DataFrame) -> DataFrame:
    grams = patterns.select("language", F.explode(q_grams(F.col("literal"))).alias("gram")).distinct()
    held = _line_grams(_lines(source_files).select("language", "line"), _among(grams)).select("language", "gram")
    counted = held.groupBy("language", "gram").agg(F.count("*").alias("n_lines"))
    return counted.join(grams, ["language", "gram"], "left_semi")


def gram_counts(source_files: DataFrame, rules: DataFrame) -> DataFrame:
    """(language, gram, n_lines) of the q-grams of the rules' literals: how many lines of the corpus hold each.

    Keep it as a table to scan again with the same rules; counts need not be exact, any choice of keys gives the same findings.
    """
    return _gram_counts(source_files, _patterns(rules))


def _pattern_keys(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    grams = patterns.select("language", "pattern", F.explode(q_grams(F.col("literal"))).alias("gram"))
    seen = grams.join(counts, ["language", "gram"], "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    rarest = seen.groupBy("language", "pattern").agg(F.min(F.struct("n_lines", "gram")).alias("key"))
    return rarest.where("key.n_lines > 0").select("language", "pattern", "key.gram")


def rule_keys(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(rule_id, language, pattern, gram): the rarest q-gram of each rule's literal. Rules with one that no line holds have no row."""
    keys = _pattern_keys(_patterns(rules), counts)
    return _named(rules).join(keys, ["language", "pattern"]).select("rule_id", "language", "pattern", "gram")


def pattern_hits(source_files: DataFrame, rules: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(repo, path, language, line, line_text, pattern): each line and pattern that meet, once, whatever number of rules share it.

    Patterns and their keys are written to the shared folder, so that the corpus is not read again for them and their
    size is known before lines are joined.
    """
    patterns = stored(_patterns(rules), "patterns")
    keys = stored(_pattern_keys(patterns, _gram_counts(source_files, patterns) if counts is None else counts), "rule-keys")
    lines = _line_grams(_lines(source_files), _among(keys))
    hits = lines.join(keys, ["language", "gram"]).where(F.expr("line RLIKE pattern"))
    found = hits.select("repo", "path", "language", F.col("line_no").alias("line"), F.col("line").alias("line_text"), "pattern")
    # Patterns that say nothing of what a line must hold: they have to be tried on every line.
    others = patterns.where("literal IS NULL").collect()
    if others:
        plain = scan_files(source_files, [(r.pattern, r.language, r.pattern) for r in others], (), (), issues=False)
        plain = plain.select("repo", "path", "language", F.inline("findings"))
        found = found.unionByName(plain.select("repo", "path", "language", "line", F.col("snippet").alias("line_text"), F.col("rule_id").alias("pattern")))
    return found


def indexed_rule_findings(source_files: DataFrame, rules: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Findings of a table of own rules (rule_id, language, pattern), the same that ``scan_files`` gives for them.

    ``counts`` comes from ``gram_counts``, from these files or from any like them that hold every file of these; without it the
    corpus is read once more. A rule given twice finds once. Patterns are searched in lines, in the Java dialect. Where very
    many rules share patterns there are as many rows as rules times lines: ``indexed_rule_totals`` counts without them.
    """
    hits = pattern_hits(source_files, rules, counts).join(_named(rules), ["language", "pattern"])
    shown = [F.lit(0).alias("col"), strip_right(F.col("line_text")).alias("snippet"), F.lit(CUSTOM_PASS).alias("pass")]
    return hits.select("repo", "path", "rule_id", "line", *shown)


def indexed_rule_totals(source_files: DataFrame, rules: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(rule_id, n_findings, n_files) of the rules that find something: ``indexed_rule_findings``, counted.

    Rules with the same patterns form a kind, and hits are counted by kind: the work grows with lines and
    patterns, and rules are only joined to the counts. Files are told apart by (repo, path), a null repo being one too.
    """
    sets = _named(rules).groupBy("rule_id").agg(F.array_sort(F.collect_set(F.struct("language", "pattern"))).alias("patterns"))
    kinds = stored(sets.select("rule_id", F.sha2(F.to_json("patterns"), 256).alias("kind"), "patterns"), "rule-kinds")
    members = stored(kinds.groupBy("kind").agg(F.any_value("patterns").alias("patterns")).select("kind", F.inline("patterns")), "kind-patterns")
    hits = pattern_hits(source_files, rules, counts).select("repo", "path", "language", "pattern").join(members, ["language", "pattern"])
    by_file = hits.groupBy("kind", "repo", "path").agg(F.count("*").alias("n"))
    by_kind = by_file.groupBy("kind").agg(F.sum("n").alias("n_findings"), F.count("path").alias("n_files"))
    return kinds.select("rule_id", "kind").join(by_kind, "kind").select("rule_id", "n_findings", "n_files")


__all__ = ["gram_counts", "indexed_rule_findings", "indexed_rule_totals", "pattern_hits", "required_literal", "rule_keys", "rules_with_literals"]
