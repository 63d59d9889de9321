"""How often rules are broken in a corpus, and which rules matter most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.fixed_rules import RULE_IDS


def _of_rule(rule: str):
    return lambda f: f["rule_id"] == rule


def rule_frequency(scanned: DataFrame, rule_ids=RULE_IDS) -> DataFrame:
    """Per rule: findings, files and repositories with it, share of repositories.

    Counts are summed per repository, then over repositories, with one column
    a rule. Both steps combine before the shuffle, so a repository or a rule
    that holds most findings costs no more than any other, and no distinct
    count is needed. Only repositories, not files, are rows after the first step.
    """
    per_repo = []
    for i, rule in enumerate(rule_ids):
        n = F.size(F.filter("findings", _of_rule(rule))).cast("long")
        per_repo += [F.sum(n).alias(f"n_{i}"), F.count_if(n > 0).alias(f"files_{i}")]
    repos = scanned.groupBy("repo").agg(*per_repo)

    totals = [F.count("*").alias("n_repos")]
    for i in range(len(rule_ids)):
        totals += [
            F.coalesce(F.sum(f"n_{i}"), F.lit(0)).alias(f"n_{i}"),
            F.coalesce(F.sum(f"files_{i}"), F.lit(0)).alias(f"files_{i}"),
            F.count_if(F.col(f"n_{i}") > 0).alias(f"repos_{i}"),
        ]
    rows = F.array(
        *(
            F.struct(
                F.lit(rule).alias("rule_id"),
                F.col(f"n_{i}").alias("n_findings"),
                F.col(f"files_{i}").alias("n_files"),
                F.col(f"repos_{i}").alias("n_repos_hit"),
                F.round(F.try_divide(F.col(f"repos_{i}") * 100.0, F.col("n_repos")), 4).alias("repo_share"),
            )
            for i, rule in enumerate(rule_ids)
        )
    )
    return repos.agg(*totals).select(F.inline(rows))


def importance(attack: str, damage: str, speed: str, detection: str, amplification: str):
    """Weighted sum of the five scores, each from 1 to 5."""
    return (
        F.col(attack) * 0.25
        + F.col(damage) * 0.25
        + F.col(speed) * 0.20
        + F.col(detection) * 0.15
        + F.col(amplification) * 0.15
    )


def rule_priority(scores: DataFrame) -> DataFrame:
    """Rank rules by importance and frequency.

    ``scores`` has one row a rule: ``rule_id``, ``importance``, ``n_found``,
    ``freq_estimate`` (used where a rule was not observed) and ``excluded``
    (why a candidate cannot be chosen). It has as many rows as there are rules,
    which is what keeps the window over all of them small.
    """
    all_rules = Window.partitionBy(F.lit(1))
    observed = F.col("n_found") > 0
    frequency = F.try_divide(
        F.log10(F.when(observed, F.col("n_found"))), F.log10(F.max("n_found").over(all_rules))
    ) * 5
    return scores.withColumn(
        "frequency", F.coalesce(F.when(observed, frequency), F.col("freq_estimate"), F.lit(0.0))
    ).withColumn("priority", F.col("importance") * 0.6 + F.col("frequency") * 0.4)


def chosen_rules(priorities: DataFrame, n: int = 7) -> DataFrame:
    """All rules with their ``rank`` by priority and whether they are ``chosen``.

    The ``n`` rules with the highest priority among those not excluded are
    chosen; an excluded rule has no rank. One row a rule keeps the window small.
    """
    candidate = F.col("excluded").isNull()
    place = F.row_number().over(Window.partitionBy(candidate).orderBy(F.col("priority").desc(), "rule_id"))
    ranked = priorities.withColumn("rank", F.when(candidate, place))
    return ranked.withColumn("chosen", F.coalesce(F.col("rank") <= n, F.lit(False)))


# Frequencies that can be merged

#: Sketches hold 2^12 registers: a standard error of 1.6 in a hundred.
SKETCH_BITS = 12


def frequency_sketches(scanned: DataFrame, *by: str) -> DataFrame:
    """Per rule and ``by`` (such as a source and a day): number of findings, and sketches of the files and repositories with it.

    Rows of any days, sources or scans, overlapping ones too, are merged by ``merged_sketches``: a file counts once however
    often it was scanned. A row is some kilobytes, whatever it counts; each partition makes its own before the shuffle.
    """
    broken = scanned.select(*by, "repo", "path", F.explode("findings.rule_id").alias("rule_id"))
    return broken.groupBy(*by, "rule_id").agg(
        F.count("*").alias("n_findings"),
        F.hll_sketch_agg(F.concat_ws("\n", "repo", "path"), F.lit(SKETCH_BITS)).alias("files"),
        F.hll_sketch_agg(F.coalesce("repo", F.lit("")), F.lit(SKETCH_BITS)).alias("repos"),
    )


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Rows of ``frequency_sketches`` put together at a coarser grain. Findings are added, files and repositories united."""
    return sketches.groupBy(*by, "rule_id").agg(
        F.sum("n_findings").alias("n_findings"), F.hll_union_agg("files").alias("files"), F.hll_union_agg("repos").alias("repos")
    )


def estimated_frequency(sketches: DataFrame) -> DataFrame:
    """The sketches' numbers of files and repositories, ``n_files`` and ``n_repos_hit``, in place of the sketches."""
    return sketches.withColumns(
        {"n_files": F.hll_sketch_estimate("files"), "n_repos_hit": F.hll_sketch_estimate("repos")}
    ).drop("files", "repos")
