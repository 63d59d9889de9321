import hashlib
import random
from collections import Counter

import pytest
from check import database, differences

from scanloom.llm.line_dedup import op11_line_dedup, without_frequent_lines
from scanloom.llm.common import table

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\f\r"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(texts, least, chars=1):
    """(kept text, lines, dropped lines) of each text, counted with dictionaries."""
    key = lambda line: fold(line.strip(BLANKS))
    seen = Counter()
    for text in texts:
        seen.update({key(line) for line in (text or "").split("\n")})
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or seen[key(x)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def run(docs, least=3, chars=1):
    return sorted((r.text, r.n_lines, r.n_dropped) for r in without_frequent_lines(docs, least, chars).collect())


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_plain_counting(documents, seed):
    draw = random.Random(seed)
    lines = ["Home", " home\t", "", "  ", "x\r", "É", "é", "naïve  line", "a" * 300, " ", "tail"]
    texts = ["\n".join(draw.choices(lines, k=draw.randint(0, 6))) for _ in range(40)] + [None, "", "\n", "\n\n"]
    assert run(documents(list(enumerate(texts)))) == sorted(plain(texts, 3))
    assert run(documents(list(enumerate(texts))), chars=0) == sorted(plain(texts, 3, 0))


def test_a_document_counts_once_and_rows_count_each(documents):
    # Nulls and repeated rows: each row is a document of its own.
    assert run(documents([(1, "a\na\na"), (2, "a")])) == [("a", 1, 0), ("a\na\na", 3, 0)]
    assert run(documents([(None, "a"), (None, "a"), (None, "a"), (4, None)])) == [("", 1, 0)] + [("", 1, 1)] * 3


def test_very_long_text_and_hot_line(documents):
    long = "\n".join(f"line {i}" if i % 3 else "SHARED" for i in range(30_000))
    rows = [(i, f"shared \nown {i}") for i in range(200)] + [(900, long)]
    texts = [t for _, t in rows]
    assert run(documents(rows), least=10) == sorted(plain(texts, 10))


def test_other_columns_and_empty_tables(spark, documents):
    docs = spark.createDataFrame([(1, "a\nb", 7, 5, "r", 1)], "doc_id long, text string, n_lines int, h1 int, row string, heavy int")
    row = without_frequent_lines(docs, 1).first()
    assert (row.doc_id, row.text, row.n_lines, row.n_dropped, row.h1, row["row"], row.heavy) == (1, "", 2, 2, 5, "r", 1)
    assert without_frequent_lines(docs.where("doc_id > 5")).collect() == []
    assert [r.text for r in without_frequent_lines(docs.select("text"), 2).collect()] == ["a\nb"]


def test_query(spark):
    assert differences(spark, database(SF), SF, "op11_line_dedup") is None
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: (n, d, hashlib.sha256(t.encode()).hexdigest()) for r, (t, n, d) in zip(docs, plain([r.text for r in docs], 10), strict=True)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op11_line_dedup(spark, SF).collect()} == want
