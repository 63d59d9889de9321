"""Suppressions as a table: findings that somebody has accepted, for some files and for some time.

An entry names a rule (or ``*`` for any), a path pattern and the time it holds. Findings meet entries by an equi-join on
the rule, on the directory that the pattern begins with and on a bucket of time; the pattern and the times decide. Of
several entries the narrowest counts. What would have been suppressed but for the time is told apart, so that expired
entries are noticed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.text import canonical_rule_id
from scanloom.operators.owners import ancestors

ANY = "*"
BUCKET_DAYS = 32
#: Entries beyond this many buckets wait in one bucket of their own, in which every finding looks too.
MOST_BUCKETS = 64
_ALWAYS = -(1 << 40)
#: Buckets of entries that have ended, and of the row that holds a finding.
_PAST, _OWN = _ALWAYS - 1, _ALWAYS - 2


#: Marks for what stands for any directories and for any path, until plain characters are escaped.
_DIRECTORIES, _BELOW = "\ue001", "\ue002"


def pattern_regex(pattern: Column) -> Column:
    """A path pattern as a regular expression: ``*`` within a name, ``**`` across, ``?`` one character, a final ``/`` all below."""
    out = F.regexp_replace(pattern, r"([.\\+^$|(){}\[\]])", r"\\$1")
    for glob, regex in ((r"\*\*/", _DIRECTORIES), (r"\*\*", _BELOW), (r"\*", "[^/]*"), (r"\?", "[^/]"), (r"/$", f"/{_BELOW}")):
        out = F.regexp_replace(out, glob, regex)
    out = F.replace(F.replace(out, F.lit(_DIRECTORIES), F.lit("(?:.*/)?")), F.lit(_BELOW), F.lit(".*"))
    return F.concat(F.lit("(?s)^"), out, F.lit("$"))


def pattern_root(pattern: Column) -> Column:
    """The path or directory that everything the pattern matches lies at or below."""
    literal = F.regexp_extract(pattern, r"^[^*?]*", 0)
    whole = (literal == pattern) & ~F.endswith(pattern, F.lit("/"))
    directory = F.regexp_replace(literal, r"[^/]*$", "")
    return F.when(whole, pattern).otherwise(F.when(directory == "/", "/").otherwise(F.regexp_replace(directory, r"/+$", "")))


def _bucket(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / (86400 * BUCKET_DAYS)).cast("long")


def _entries(entries: DataFrame) -> DataFrame:
    named = entries.select(
        "entry_id",
        F.when(F.col("rule_id") == ANY, ANY).otherwise(canonical_rule_id(F.col("rule_id"))).alias("for_rule"),
        "path_pattern",
        pattern_root(F.col("path_pattern")).alias("ancestor"),
        pattern_regex(F.col("path_pattern")).alias("regex"),
        "valid_from",
        "valid_to",
        "reason",
    )
    right = F.col("valid_from").isNull() | F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to"))
    return named.where(F.col("path_pattern").isNotNull() & F.col("for_rule").isNotNull() & right)


def _narrowness() -> Column:
    """Least first: deepest directory, longest literal, one rule before any, shortest time, then the entry's id."""
    literal = F.length(F.regexp_replace("path_pattern", r"[*?]", ""))
    span = F.coalesce(F.unix_seconds("valid_to"), F.lit(1 << 40)) - F.coalesce(F.unix_seconds("valid_from"), F.lit(-(1 << 40)))
    return F.struct((-F.length("ancestor")).alias("a"), (-literal).alias("b"), (F.col("for_rule") == ANY).alias("c"), span.alias("d"), F.col("entry_id").alias("entry_id"), F.col("reason").alias("reason"))


def judged(findings: DataFrame, entries: DataFrame, time: str = "mtime") -> DataFrame:
    """``findings`` with ``status`` (``kept``, ``suppressed``, ``expired``), ``entry_id`` and ``reason``.

    ``findings`` has repo, path, rule_id, pass, seq and ``time``; ``entries`` has entry_id, rule_id, path_pattern, valid_from
    (included, null: always), valid_to (excluded, null: for ever) and reason. ``expired`` findings are kept ones that an entry
    matched until it ended; the entry that ended last is named. Entries that end before they begin, or lack a rule or
    a pattern, never match. Findings without a time match entries without limits
    only, and never expire. A finding comes back once, however many entries match.
    """
    named = _entries(entries)
    key = ["repo", "path", "pass", "seq"]
    told = [c for c in findings.columns if c not in ("status", "entry_id", "reason")]

    # Entries that hold now: by bucket of time. Long ones are few buckets' worth of work in one of their own.
    first, last = _bucket(F.col("valid_from")), _bucket(F.col("valid_to") - F.expr("INTERVAL 1 MICROSECOND"))
    short = F.coalesce((last - first).between(0, MOST_BUCKETS), F.lit(False))
    buckets = F.when(short, F.sequence(first, F.when(short, last).otherwise(first))).otherwise(F.array(F.lit(_ALWAYS)))
    dated = named.select(
        "for_rule", "ancestor", "regex", "valid_from", "valid_to", _narrowness().alias("narrow"),
        F.lit(None).cast(f"struct<valid_to:timestamp,entry_id:{dict(named.dtypes)['entry_id']},reason:{dict(named.dtypes)['reason']}>").alias("end"),
        F.explode(buckets).alias("bucket"),
    )
    # Entries that held before: the last end of each rule and pattern is enough.
    past = named.where("valid_to IS NOT NULL").groupBy("for_rule", "ancestor", "regex").agg(
        F.max(F.struct("valid_to", "entry_id", "reason")).alias("end")
    )
    past = past.withColumns({"bucket": F.lit(_PAST), "valid_to": F.col("end.valid_to")})
    dated = dated.unionByName(past, allowMissingColumns=True)

    # Findings look once, in an outer join: Spark takes them for small, as it does not see how they multiply, and in an
    # inner join would send them through the driver. One row of a finding holds it and meets no entry.
    path, at = F.col("path"), F.col(time)
    looked = findings.select(*key, "rule_id", at.alias("at"), F.struct(*told).alias("told"), F.inline_outer(ancestors(path)))
    looked = looked.select("*", F.posexplode(F.array(canonical_rule_id(F.col("rule_id")), F.lit(ANY))).alias("nth", "for_rule"))
    whole = (F.col("nth") == 0) & (F.col("depth").isNull() | (F.col("depth") == F.element_at(ancestors(path), -1)["depth"]))
    at_all = F.array(_bucket(F.col("at")), F.lit(_ALWAYS), F.lit(_PAST), F.when(whole, F.lit(_OWN)))
    looked = looked.withColumn("bucket", F.explode(F.array_compact(at_all)))
    looked = looked.withColumn("told", F.when(F.col("bucket") == _OWN, F.col("told"))).drop("depth", "nth", "rule_id")
    met = looked.join(dated, ["for_rule", "ancestor", "bucket"], "left")

    began = F.col("valid_from").isNull() | (F.col("at") >= F.col("valid_from"))
    ended = F.coalesce(F.col("at") >= F.col("valid_to"), F.lit(False))
    holds = F.coalesce(began, F.lit(False)) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    matches = F.col("regex").isNotNull() & F.coalesce(F.expr("path RLIKE regex"), F.lit(False))
    hit = F.when(matches & (F.col("bucket") != _PAST) & holds, F.col("narrow"))
    gone = F.when(matches & (F.col("bucket") == _PAST) & ended, F.col("end"))
    met = met.select(*key, "told", hit.alias("hit"), gone.alias("end"))
    met = met.where("told IS NOT NULL OR hit IS NOT NULL OR end IS NOT NULL")
    rows = met.groupBy(*key).agg(F.min("hit").alias("hit"), F.max("end").alias("end"), F.collect_list("told").alias("held"))
    status = F.when(F.col("hit").isNotNull(), "suppressed").when(F.col("end").isNotNull(), "expired").otherwise("kept")
    judgement = (
        status.alias("status"),
        F.coalesce("hit.entry_id", "end.entry_id").alias("entry_id"),
        F.coalesce("hit.reason", F.when(F.col("hit").isNull(), F.col("end.reason"))).alias("reason"),
    )
    return rows.select(*judgement, F.inline("held")).select(*told, "status", "entry_id", "reason")
