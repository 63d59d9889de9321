"""Which root a path belongs to: the deepest of a table of roots that is the path itself or a directory above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the paths below one root are dealt into where roots are joined by a shuffle: all paths share the upper ones.
SALTS = 16


def ancestors(path: Column) -> Column:
    """The path, each directory above it and the empty root, as structs of (depth, ancestor). Slashes at ends do not count."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    lead = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.concat(lead, F.array_join(F.slice(parts, 1, n), "/")).alias("ancestor")),
    )


def _clean(path: Column) -> Column:
    """A path as ``ancestors`` names it."""
    return F.element_at(ancestors(path), -1)["ancestor"]


def owned(files: DataFrame, roots: DataFrame, salts: int = SALTS) -> DataFrame:
    """``files`` with ``root`` and ``owner`` of the deepest root at or above their path, null where there is none.

    ``roots`` has ``root`` and ``owner``, and may have ``repo``: such a root holds in that repository alone, one with a
    null ``repo`` in all, and of two equally deep ones the repository's own wins; then the least owner. ``src`` is no root of
    ``src2/a.py``. A root ``""`` (or ``/`` for absolute paths) owns all. Only paths are shuffled, not texts.
    """
    named = roots.select(
        _clean(F.col("root")).alias("ancestor"), F.col("root").alias("root"), F.col("owner").alias("owner"),
        (F.col("repo") if "repo" in roots.columns else F.lit(None).cast("string")).alias("of_repo"),
    )
    named = named.where("ancestor IS NOT NULL").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    paths = files.select("repo", "path").distinct()
    above = paths.select("repo", "path", F.pmod(F.xxhash64("repo", "path"), F.lit(salts)).cast("int").alias("salt"), F.inline(ancestors(F.col("path"))))
    # Generators multiply rows unseen by Spark's estimate, which would have it broadcast all paths with all their ancestors.
    held = above.join(named.hint("merge"), ["ancestor", "salt"]).where(F.col("of_repo").isNull() | (F.col("of_repo") == F.col("repo")))
    # Deepest first, then the repository's own, then by name.
    order = F.struct(-F.col("depth"), F.col("of_repo").isNull(), "owner", "root")
    best = held.groupBy(F.col("repo").alias("__repo"), F.col("path").alias("__path")).agg(F.min(order).alias("__best"))
    same = F.col("repo").eqNullSafe(F.col("__repo")) & (F.col("path") == F.col("__path"))
    rest = [c for c in files.columns if c not in ("root", "owner")]
    return files.select(*rest).join(best.hint("merge"), same, "left").select(*rest, "__best.root", "__best.owner")
