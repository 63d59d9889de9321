"""Lines that many documents share are dropped.

Texts are exploded into lines; a line's key is the line without blanks at its ends, in lower case, as two 64-bit
hashes. Documents are counted by key in partial sums, and keys of too many documents are written as a table. Each line
is then joined with that table, and what is left of a document is put together again by position.

Few keys can hold more than a ``HEAVY``-th of the lines of that table: those are broadcast, and their lines do not take
part in the shuffle join. Nor do blank lines; both are dealt by row and place instead, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import table, written

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of at least LEAST_CHARS code points found in LEAST_DOCUMENTS documents are dropped.
LEAST_DOCUMENTS = 10
LEAST_CHARS = 1
HEAVY = 1024


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def frequent_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, n_documents, n_lines) of the keys that at least ``least`` rows of ``docs`` hold."""
    keys = F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= chars)

    def counted(some: Column, documents: int, lines: int) -> Column:
        return F.transform(some, lambda k: F.struct(*_hashes(k), F.lit(documents).alias("d"), F.lit(lines).alias("n")))

    # A key counts once a document, and once a line.
    seen = docs.select(keys.alias("keys")).select(F.inline(F.concat(counted(F.array_distinct("keys"), 1, 0), counted(F.col("keys"), 0, 1))))
    return seen.groupBy("h1", "h2").agg(F.sum("d").alias("n_documents"), F.sum("n").alias("n_lines")).where(F.col("n_documents") >= least)


def without_frequent_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` (text, any other columns) without frequent lines, with ``n_lines`` (before) and ``n_dropped``.

    Every row is a document of its own, also one that repeats another or has no id. A null or empty text is one empty
    line, and comes back as an empty text; a text whose lines all go is empty too. A line counts once a document however
    often it stands there. Blank lines stay unless ``chars`` is 0. Texts of any length are whole; the lines of one
    text meet in one row. An empty table gives an empty one. Columns of ``docs`` with the names of new ones give way.
    ``docs`` is read twice and should come from a table.
    """
    new = ["n_lines", "n_dropped"]
    old = [c for c in docs.columns if c not in new]
    frequent = written(frequent_lines(docs, least, chars), "frequent")
    total = frequent.agg(F.sum("n_lines")).first()[0] or 0
    # At most HEAVY keys, as their lines add up to the total.
    is_heavy = F.col("n_lines") * HEAVY >= F.lit(total)
    heavy = F.broadcast(frequent.where(is_heavy).select("h1", "h2", F.lit(True).alias("heavy")))
    light = frequent.where(~is_heavy).select("h1", "h2", F.lit(True).alias("light"))

    others = F.struct(*[c for c in old if c != "text"]) if len(old) > 1 else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), others.alias("others"), "text")
    # The other columns of a document go with its first line only.
    lines = rows.select("row", "others", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    lines = lines.withColumn("others", F.when(F.col("at") == 0, F.col("others")))
    key = line_key(F.col("line"))
    lines = lines.select("*", (F.length(key) >= chars).alias("counts"), *_hashes(key)).join(heavy, ["h1", "h2"], "left")
    asked = F.col("counts") & F.col("heavy").isNull()
    lines = lines.withColumn("gone", F.col("counts") & F.col("heavy").isNotNull())
    lines = lines.select(
        "row", "others", "at", "gone", F.when(~F.col("gone"), F.col("line")).alias("line"),
        F.when(asked, F.col("h1")).otherwise(F.xxhash64("row", "at")).alias("h1"), F.when(asked, F.col("h2")).alias("h2"),
    )
    lines = lines.join(light, ["h1", "h2"], "left").withColumn("gone", F.col("gone") | F.col("light").isNotNull())
    kept = F.sort_array(F.collect_list(F.when(~F.col("gone"), F.struct("at", "line"))))
    whole = lines.groupBy("row").agg(
        F.first("others", ignorenulls=True).alias("others"),
        F.array_join(F.transform(kept, lambda k: k["line"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("gone").alias("n_dropped"),
    )
    return whole.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in old], *new)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op11_line_dedup": op11_line_dedup}

ORACLE = {
    "op11_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT row, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}),
g AS (
  SELECT row, count(*) AS n_lines, count(f.key) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '') AS kept
  FROM k LEFT JOIN f ON k.key = f.key GROUP BY row)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (row)
"""
}
