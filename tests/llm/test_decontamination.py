"""The q-gram filter against aligning every piece with every text, and planted leaks."""

import random

import numpy as np

from scanloom.llm.decontamination import clean_documents, indexed, leaked_regions, leaks, normal, op3_decontamination


def nearest(piece, text):
    """Fewest edits of a piece within a text, ends free."""
    row = np.zeros(len(text) + 1, np.int64)
    across = np.arange(len(text) + 1)
    for c in piece:
        step = np.concatenate(([row[0] + 1], np.minimum(row[:-1] + (text != c), row[1:] + 1)))
        row = np.minimum.accumulate(step - across) + across
    return row.min()


def by_hand(texts, items):
    pieces = indexed(items)
    out = set()
    for t, text in enumerate(texts):
        chars = normal([text])[0]
        for p, (item, n, k) in enumerate(zip(pieces.items, pieces.lengths, pieces.edits)):
            if nearest(pieces.chars[p, :n], chars) <= k:
                out.add((t, int(item)))
    return out


def edited(rnd, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(chars))
        chars[at : at + rnd.choice((0, 1))] = rnd.choice(("", "q", "zz"))
    return "".join(chars)


def test_like_aligning_everything():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(("an", "the", "of", "ti", "on", "re", "st", "é", "in")) for _ in range(rnd.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rnd.randrange(10, 60))) for i in range(14)] + [(99, "short"), (100, None)]
    texts = []
    for _ in range(60):
        text = prose(rnd.randrange(0, 120))
        if rnd.random() < 0.8:
            item = rnd.choice(items[:14])[1]
            low = rnd.randrange(max(1, len(item) // 2))
            part = edited(rnd, item[low : low + rnd.randrange(60, 400)], rnd.choice((0, 1, 3, 5, 9, 15)))
            at = rnd.randrange(len(text) + 1)
            text = text[:at] + " " + (part.upper() if rnd.random() < 0.3 else part) + " " + text[at:]
        texts.append(text)
    assert {(t, i) for t, i, *_ in leaks(texts, indexed(items))} == by_hand(texts, items)


def test_places(spark, documents):
    rnd = random.Random(1)
    item = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    text = "Ünrelated — words. " * 5 + item.upper().replace(" ", ",\n ") + " and more."
    (t, i, start, end, pieces, edits), = leaks(["", text], indexed([(7, item)]))
    assert (t, i, edits) == (1, 0, 0) and pieces > 3
    assert text[start:end].lower().replace(",\n ", " ") == item
    bench = spark.createDataFrame([(7, item), (8, None), (None, "")], "item_id long, text string")
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (5, "x y " * 60_000 + text), (6, item[:60]), (7, "nothing here")]
    frame = documents(rows).selectExpr("*", "1 as item_id", "2 as start")
    got = leaked_regions(frame, bench.selectExpr("*", "1 as doc_id")).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 7), ("1", 7), ("5", 7), ("None", 7)]
    kept = clean_documents(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 7]
    assert leaked_regions(documents([]), bench).collect() == []
    assert leaked_regions(frame, bench.where("false")).collect() == [] and clean_documents(frame, bench.where("false")).count() == len(rows)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, folder).collect()}
    plain = {(d, i) for d, t in docs.items() for i, b in items.items() if b.lower() in t.lower()}
    assert plain and got == plain


WORDS = [w + x for w in ("river", "stone", "garden", "letter", "window", "morning", "silver", "paper") for x in ("", "s", "ing", "less", "ward", "like")]


def holding(part, rnd):
    """A text of other words with a passage in it."""
    other = lambda n: " ".join("".join(rnd.choice("bcdfgklmpqvxz") for _ in range(rnd.randrange(3, 9))) for _ in range(n))
    return f"{other(rnd.randrange(30))} {part} {other(rnd.randrange(30))}"


def test_passages_anywhere():
    """Against plain search: every verbatim passage of 79 characters or more, cut at any place, has a row."""
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(20, 60)))) for i in range(20)]
    pieces = indexed(items)
    texts, want = [], set()
    for _ in range(300):
        i, item = rnd.choice(items)
        size = rnd.randrange(79, 111)
        low = rnd.randrange(len(item) - size + 1)
        texts.append(holding(item[low : low + size], rnd))
        want |= {(len(texts) - 1, j) for j, other in items if item[low : low + size] in other}
    got = {(t, i) for t, i, *_ in leaks(texts, pieces)}
    assert want <= got
    assert leaks([holding("", rnd) for _ in range(100)], pieces) == []


def test_replaced_words():
    """Whole items with every tenth or twelfth word replaced, and items of one piece or two with one word replaced."""
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(11, 50)))) for i in range(60)]
    texts = []
    for _, item in items:
        words = item.split()
        every = rnd.choice((10, 12)) if len(words) > 20 else len(words)
        for at in range(rnd.randrange(every), len(words), every):
            words[at] = "zqxvkj"[: len(words[at])]
        texts.append(holding(" ".join(words), rnd))
    assert {(t, i) for t, i, *_ in leaks(texts, indexed(items))} >= {(i, i) for i, _ in items}


def test_long_texts_in_chunks():
    rnd = random.Random(6)
    item = " ".join(rnd.choice(WORDS) for _ in range(30))
    for before in range((1 << 17) - 260, (1 << 17) + 40, 20):
        assert {i for _, i, *_ in leaks(["x" * before + " " + item], indexed([(3, item)]))} == {0}


def test_short_items_as_they_are(spark, documents):
    items = [(1, "What is the capital?"), (2, "a"), (3, "Zürich, 1848"), (4, "b c"), (5, "--"), (6, "what is the capital"), (7, "a" * 31)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        "So: what IS\tthe capital? Nobody knows.", "what is the capitals", "somewhat is the capital", "In zürich 1848 it was", "a", "b - c", "bc", "abc a",
        "x" * 300_000 + " What is the capital", "a" * 32, "b c" * 2, "what is the capital what is the capital",
    ]
    got = sorted((r.doc_id, r.item_id, texts[r.doc_id][r.start : r.end], r.pieces, r.edits) for r in leaked_regions(documents(list(enumerate(texts))), bench).collect())
    whole = "What is the capital"
    assert got == [
        (0, 1, "what IS\tthe capital", 0, 0), (0, 6, "what IS\tthe capital", 0, 0), (3, 3, "zürich 1848", 0, 0), (4, 2, "a", 0, 0), (5, 4, "b - c", 0, 0),
        (7, 2, "a", 0, 0), (8, 1, whole, 0, 0), (8, 6, whole, 0, 0), *((11, i, whole.lower(), 0, 0) for i in (1, 1, 6, 6)),
    ]
    # Short words are no reason to drop a document.
    assert sorted(r.doc_id for r in clean_documents(documents(list(enumerate(texts))), bench).collect()) == [1, 2, 3, 4, 5, 6, 7, 9, 10]


def test_short_items_against_plain_search():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 6)))) for i in range(80)]
    texts = [" ".join(word() for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    got = {(t, i) for t, i, *_ in leaks(texts, indexed(items))}
    assert got == {(t, i) for t, text in enumerate(texts) for i, item in items if f" {item} " in f" {text} "}


def test_a_large_benchmark_is_one_pass(spark, documents):
    rnd = random.Random(3)
    items = [(i, " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(60))) for i in range(1000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, "before " + items[i * 37][1][40:300] + " after") for i in range(20)]
    found = leaked_regions(documents(rows), bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i * 37) for i in range(20)}
