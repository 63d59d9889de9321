"""The histogram and its sums against counting every text."""

from collections import Counter

from pyspark.sql import functions as F

from scanloom.llm.token_counts import VOCABULARY, by_limit, encoder, length_histogram, op4_token_counts, quantile, truncated_total


def lengths_of(texts):
    with open(VOCABULARY, "rb") as file:
        encode = encoder(file.read())
    for t in texts:
        if t:
            assert encode.decode(encode.encode_ordinary(t)) == t
    return [len(encode.encode_ordinary(t)) if t else 0 for t in texts]


def check(frame, texts):
    lengths = sorted(lengths_of(texts))
    rows = {r.limit: r for r in frame.collect()}
    assert {n: r.documents for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        longer = [x for x in lengths if x > n]
        assert (r.tokens, r.longer_documents, r.longer_tokens) == (n * lengths.count(n), len(longer), sum(longer))
        assert r.kept_tokens == sum(min(x, n) for x in lengths)
        assert abs(r.share_fitting - (len(lengths) - len(longer)) / len(lengths)) < 1e-12
    return lengths


def test_whole_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = op4_token_counts(spark, "/root/testdata/sf0.001")
    lengths = check(frame, texts)
    for share in (0.1, 0.5, 0.9, 1.0):
        got = frame.agg(quantile(frame, share).alias("q")).first().q
        assert got == next(x for x in lengths if sum(y <= x for y in lengths) >= share * len(lengths))


def test_edge_cases(spark, documents):
    texts = [None, "", "a", "a", " \n ", "naïve <|endoftext|> ü", "word " * 30_000, "x" * 50_000]
    frame = documents(list(enumerate(texts))).selectExpr("*", "1 as length", "2 as documents")
    histogram = length_histogram(frame)
    lengths = check(by_limit(histogram), texts)
    got = {r["limit"]: r.kept_tokens for r in truncated_total(histogram, [0, 1, 7, 5000, 10**6]).collect()}
    assert got == {n: sum(min(x, n) for x in lengths) for n in (0, 1, 7, 5000, 10**6)}
    assert by_limit(length_histogram(documents([]))).collect() == []
    assert length_histogram(documents([(None, None)])).agg(F.sum("documents")).first()[0] == 1
