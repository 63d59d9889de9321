import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from scanloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Make source files from {path: text}."""

    def make(texts: dict, repo: str = "r"):
        rows = [(repo, path, text, None, None) for path, text in texts.items()]
        frame = spark.createDataFrame(rows, "repo string, path string, text string, mtime timestamp, error string")
        from pyspark.sql import functions as F

        from scanloom.functions.text import detect_language

        return frame.withColumn("language", detect_language(F.col("path")))

    return make


@pytest.fixture(scope="session")
def found(spark, files):
    """Findings of {path: text} as {path: [(rule, line), ...]} in scan order."""
    from scanloom.operators.scan import scan_files

    def run(texts: dict):
        rows = scan_files(files(texts)).select("path", "findings").collect()
        return {r.path: [(f.rule_id, f.line) for f in r.findings] for r in rows}

    return run
