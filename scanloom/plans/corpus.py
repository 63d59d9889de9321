"""A corpus of small source files derived from the key of any table.

``template = key % 37`` chooses a snippet and the key is written into it, so
the corpus grows with the table it is made from. Spark builds the texts with
a lookup in a constant array; no file is made up outside the query.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.text import detect_language

N_TEMPLATES = 37
#: What stands before and after a text that a source file carries.
PY_BEFORE, PY_AFTER = 'NOTE = """\n', '\n"""\nDEBUG = True\n'
JS_BEFORE, JS_AFTER = "/*\n", "\n*/\nexec(1);\n"
SCORE_COLUMNS = {
    "rule_id": pa.string(), "importance": pa.float64(), "freq_estimate": pa.float64(), "excluded": pa.string()
}


@dataclass(frozen=True)
class Template:
    number: int
    ending: str
    text: str
    expected: tuple[tuple[str, int], ...]
    syntax_line: int


@cache
def templates() -> list[Template]:
    rows = Path(__file__).with_name("templates.jsonl").read_text(encoding="utf-8").splitlines()
    loaded = (json.loads(row) for row in rows if row)
    return [
        Template(r["t"], r["ext"], r["text"], tuple((rule, line) for rule, line in r["expect"]), r["syntax"])
        for r in loaded
    ]


def _sql_literal(value) -> str:
    """A constant in SQL text; ``$`` is escaped because ``${name}`` would be substituted."""
    if value is None:
        return "NULL"
    if not isinstance(value, str):
        return str(value)
    escapes = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "$": "\\u0024"}
    return "'" + "".join(escapes.get(c, c) for c in value) + "'"


def by_template(template: Column, value) -> Column:
    """Look up what belongs to a template, from one constant array."""
    values = ", ".join(_sql_literal(value(t)) for t in templates())
    return F.get(F.expr(f"array({values})"), template.cast("int"))


def template_text(key: Column, template: Column) -> Column:
    return F.replace(by_template(template, lambda t: t.text), F.lit("<k>"), key.cast("string"))


def spread(rows: DataFrame, key: str, repo: str) -> DataFrame:
    """Keys and repositories of a table, spread by hash before texts are made from them.

    Only these two columns are shuffled. Tables that hold texts are never spread.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(key, repo).repartition(tasks, key)


def mirrored(files: DataFrame) -> DataFrame:
    """Every file also in a second repository, under the same path."""
    return files.unionByName(files.withColumn("repo", F.lit("mirror")))


def corpus(table: DataFrame, key: str, repo: Column, mtime: Column | None = None) -> DataFrame:
    """``source_files`` made from the rows of a table, one file a row."""
    template = F.col(key) % N_TEMPLATES
    ending = by_template(template, lambda t: t.ending)
    path = F.concat(F.lit("src/t"), template.cast("string"), F.lit("/f"), F.col(key).cast("string"), ending)
    named = table.select(
        repo.alias("repo"),
        path.alias("path"),
        template_text(F.col(key), template).alias("text"),
        (mtime if mtime is not None else F.lit(None).cast("timestamp")).alias("mtime"),
        F.lit(None).cast("string").alias("error"),
        F.col(key).alias("key"),
    )
    return named.select("repo", "path", detect_language(F.col("path")).alias("language"), "text", "mtime", "error", "key")
