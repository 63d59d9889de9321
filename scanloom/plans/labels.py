"""Labelled cases and candidate patches derived from the template corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.text import lines_of, snippet
from scanloom.plans.corpus import N_TEMPLATES, Template, by_template, corpus, mirrored, spread, template_text, templates

# Flaws of templates that the rules are known to miss: (rule, line, why).
BLIND = {
    3: ("NO_HARDCODED_SECRETS", 1, "keyword inside a longer name"),
    7: ("SQL_PARAM_BINDING", 2, "left operand is a sum"),
    25: ("NO_EXEC", 1, "call on a module expression"),
    32: ("NO_BARE_EXCEPT", 1, "catch without a binding"),
}

# Labels that point one line too far, so that misses and unexpected lines occur.
MISLABELLED = (28,)

# Template whose text serves as the patched file of a vulnerable one. Two are
# special: 13 gets a text that cannot be parsed, 14 gets its own text back.
SAFE = {
    1: 0, 4: 5, 6: 8, 9: 10, 11: 12, 13: 18, 14: 14, 15: 17, 16: 17, 19: 11, 20: 21,
    22: 23, 24: 25, 26: 30, 27: 35, 28: 30, 29: 30, 31: 32, 33: 35, 34: 35,
}

# Templates whose first finding was attempted, and those whose attempts are spent.
TRIED = (1, 4, 18, 19, 22, 31)
SPENT = (6, 29)

# Templates of which an earlier round proposed the old text once more.
AGAIN = (1, 22)

TOOLS = ("alpha", "beta", "gamma")
SOURCES = ("set one", "set two", "set three")


def case_of(t: Template) -> tuple[str, str, list[int], int]:
    """Category, rule, expected lines and expected number of findings of a template."""
    if t.number in BLIND:
        rule, line, _ = BLIND[t.number]
        return "blind_spot", rule, [line], 1
    if not t.expected:
        return "false_positive", "NO_EXEC", [], 0
    rule = t.expected[0][0]
    lines = sorted({line for r, line in t.expected if r == rule})
    if t.number in MISLABELLED:
        lines = [line + 1 for line in lines]
    return "vulnerable", rule, lines, len(t.expected)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spread(spark.read.parquet(f"{folder}/part.parquet"), "p_partkey", "p_brand"), "p_partkey", F.col("p_brand"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One labelled case for every file made from ``part``, in both of its repositories."""
    files = mirrored(_files(spark, folder))
    key, t = F.col("key"), F.col("key") % N_TEMPLATES
    cases = [case_of(x) for x in templates()]
    lines = F.array(*(F.array(*(F.lit(n) for n in c[2])).cast("array<int>") for c in cases))
    # The file of the template before serves as the fixed counterpart of template 1.
    fixed = F.when(t == 1, F.concat(F.lit("src/t0/f"), (key - 1).cast("string"), F.lit(".py")))
    return files.select(
        "repo",
        F.concat(F.lit("case-"), key, F.lit("-"), "repo").alias("case_id"),
        F.lit("derived").alias("dataset"),
        by_template(t, lambda x: case_of(x)[0]).alias("category"),
        "language",
        by_template(t, lambda x: case_of(x)[1]).alias("rule"),
        F.col("path").alias("file"),
        F.get(lines, t.cast("int")).alias("expected_lines"),
        by_template(t, lambda x: case_of(x)[3]).alias("expected_count"),
        F.lit(True).alias("patchable"),
        F.array(_pick(SOURCES, key), F.lit("set zero")).alias("source_datasets"),
        fixed.alias("fixed_file"),
        by_template(t, lambda x: BLIND.get(x.number, (None,))[-1]).alias("blind_spot_reason"),
    )


def _pick(names: tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*(F.lit(n) for n in names)), (key % len(names)).cast("int"))


def safe_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Responses of a patching tool for every file with a finding and a safe text."""
    files = _files(spark, folder)
    key, t = F.col("key"), F.col("key") % N_TEMPLATES
    safe = by_template(t, lambda x: SAFE.get(x.number))
    fence = F.lit("```")
    rounds = F.when(t.isin(*AGAIN), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    proposed = files.where(safe.isNotNull()).withColumn("round", F.explode(rounds))
    code = F.when(F.col("round") == 0, F.col("text")).otherwise(template_text(key, safe))
    return proposed.select(
        "repo",
        "path",
        by_template(t, lambda x: x.expected[0][0] if x.expected else None).alias("rule_id"),
        by_template(t, lambda x: x.expected[0][1] if x.expected else None).alias("line"),
        _pick(TOOLS, key).alias("tool"),
        "round",
        F.concat(F.lit("Here it is:\n"), fence, F.lit("\n"), code, fence, F.lit("\n")).alias("response"),
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts made so far: the first finding of files of some templates, and
    twenty attempts, which is all a file gets, in files of others."""
    files = _files(spark, folder)
    t = F.col("key") % N_TEMPLATES
    line = by_template(t, lambda x: x.expected[0][1] if x.expected else None)
    known = files.select(
        "repo",
        "path",
        by_template(t, lambda x: x.expected[0][0] if x.expected else None).alias("rule_id"),
        line.alias("line"),
        snippet(lines_of(F.col("text")), line).alias("snippet"),
        by_template(t, lambda x: x.number in TRIED).alias("tried"),
        by_template(t, lambda x: x.number in SPENT).alias("spent"),
    )
    spent = known.where("spent").withColumns(
        {"rule_id": F.lit("OTHER"), "line": F.explode(F.sequence(F.lit(1), F.lit(20)))}
    )
    return known.where("tried").unionByName(spent).drop("tried", "spent")
