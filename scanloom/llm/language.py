"""Language identification as inference of a mixture.

Each language has a distribution over hashed character n-grams, smoothed, from labelled documents. A document's
n-grams are taken as drawn from a mixture of languages whose proportions expectation-maximisation finds. Which
languages the mixture has is chosen by penalised likelihood: the best single language first, then one more at a time
while the likelihood gains more than a penalty that grows with the log of the document's length. A language is tried
only where the slope of the likelihood towards it is upward; as the likelihood is concave, no other can gain.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from scanloom.llm.common import held_out, mixed, slices, small_batches, table

ORDERS = (1, 2, 3, 4)
BINS = 1 << 15
#: At most about so many labelled documents of a language are learned from, dealt by hash of the id.
DOCUMENTS_A_LANGUAGE = 3000
SMOOTHING = 0.5
STEPS = 20
#: A further language must gain this many times the log of the number of n-grams.
PENALTY = 3.0
#: The pipeline rejects documents in which no language has this share: mixtures of many, and texts without letters.
ACCEPTED_SHARE = 0.3
#: It also rejects texts whose n-grams gain less over uniform ones than this part of what the found languages' own do.
LEAST_GAIN = 0.6
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case form of each code point of the basic plane that is a letter, else 0."""
    codes = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            codes[c] = ord(low) if len(low) == 1 else c
    return codes


@lru_cache(maxsize=1)
def _high_letters() -> np.ndarray:
    return np.array([c for c in range(1 << 16, 0x110000) if chr(c).isalpha()], np.uint32)


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, a 0 for each run of anything else, and where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = _letters()[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        high = points > 0xFFFF
        plain[high] = np.where(np.isin(points[high], _high_letters()), points[high], 0)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    letter = plain > 0
    first = np.zeros(len(points) + 1, bool)
    first[begin] = True
    # Of a run without letters, the first stays; one at a text's start goes.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep &= letter | ~first[:-1]
    at = np.concatenate(([0], np.cumsum(keep)))[begin]
    return plain[keep], at


def ngram_bins(letters: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all n-grams (inside words and over one gap at most), and the text each belongs to."""
    size = len(letters)
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    codes = mixed(letters.astype(np.uint64))
    bins, owners = [], []
    hashed = np.zeros(size, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if size < n:
            break
        hashed = hashed[: size - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in ORDERS:
            fits = owner[: size - n + 1] == owner[n - 1 :]
            if n == 1:
                fits &= letters > 0
            value = mixed(hashed + np.uint64(n)) >> np.uint64(49)
            bins.append(value[fits].astype(np.int64))
            owners.append(owner[: size - n + 1][fits])
    if not bins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(bins), np.concatenate(owners)


@dataclass
class Languages:
    names: list[str]
    #: Log-probability of each bin (rows) in each language.
    chances: np.ndarray

    @property
    def gains(self) -> np.ndarray:
        """Mean log-likelihood of a language's own n-grams, over that of uniform ones."""
        return (self.chances * np.log(np.maximum(self.chances * BINS, 1e-300))).sum(axis=0)


def _count(batches):
    """Counts of n-gram bins by language, one row a language and task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        for low, high in slices(at, 1 << 17):
            letters, begin = letters_of(texts[low:high])
            bins, owner = ngram_bins(letters, begin)
            for lang in set(langs[low:high]):
                own = np.array([x == lang for x in langs[low:high]])
                sums.setdefault(lang, np.zeros(BINS, np.int64))[:] += np.bincount(bins[own[owner]], minlength=BINS)
    for lang, counts in sums.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["lang", "bin", "seen"])


def learned(docs: DataFrame, documents: int = DOCUMENTS_A_LANGUAGE) -> Languages:
    """Learn languages from (doc_id, text, lang); null texts and languages teach nothing."""
    small_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    # A share of each language by hash of the id, so that about as many documents as asked for come from each.
    share = F.lit(0)
    for lang, count in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, documents / count) * 1_000_000))).otherwise(share)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("text", "lang")
    counts = some.mapInArrow(_count, "lang string, bin int, seen long").groupBy("lang", "bin").agg(F.sum("seen").alias("seen"))
    got = counts.toPandas()  # languages times bins at most
    names = sorted(sizes)
    seen = np.zeros((BINS, len(names)))
    place = {n: i for i, n in enumerate(names)}
    seen[got["bin"].to_numpy(int), [place[x] for x in got["lang"]]] = got["seen"].to_numpy(float)
    chances = (seen + SMOOTHING) / (seen.sum(axis=0) + SMOOTHING * BINS) if names else seen
    return Languages(names, chances)


def proportions(chances: np.ndarray, counts: np.ndarray, start: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Proportions of the languages by expectation-maximisation, and the log-likelihood."""
    share, total = start, counts.sum()
    for _ in range(steps):
        weighted = chances * share
        mix = weighted.sum(axis=1)
        after = (counts / mix) @ weighted / total
        if np.abs(after - share).max() < 1e-4:
            share = after
            break
        share = after
    return share, float(counts @ np.log(chances @ share))


def mixture(chances: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> dict[int, float]:
    """{language: proportion} of a document, from chances of its n-grams (rows) by language and their counts."""
    single = counts @ np.log(chances)
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single.max())
    total = counts.sum()
    price = penalty * np.log(total + 1)
    while len(chosen) < chances.shape[1]:
        slope = (counts / (chances[:, chosen] @ share)) @ chances - total
        slope[chosen] = -1
        tried = []
        for k in np.flatnonzero(slope > 0).tolist():
            start = np.append(share * 0.9, 0.1)
            tried.append((*reversed(proportions(chances[:, [*chosen, k]], counts, start)), k))
        if not tried:
            break
        likely, after, k = max(tried, key=lambda x: (x[0], -x[2]))
        if likely - best <= price:
            break
        chosen, share, best = [*chosen, k], after, likely
    return dict(zip(chosen, share.tolist(), strict=True))


def identify(texts: list[str], model: Languages) -> tuple[list[str], list[float], list[str]]:
    """Language, its proportion, and the whole mixture of each text."""
    return fitted(texts, model)[:3]


def fitted(texts: list[str], model: Languages) -> tuple[list[str], list[float], list[str], list[float]]:
    """As ``identify``, and the gain of each text over uniform n-grams as a part of its languages' own (about 1 if it fits)."""
    langs, scores, mixes = [UNKNOWN] * len(texts), [0.0] * len(texts), [""] * len(texts)
    fits, gains = [0.0] * len(texts), model.gains
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for low, high in slices(at, 1 << 17):
        letters, begin = letters_of(texts[low:high])
        bins, owner = ngram_bins(letters, begin)
        order = np.argsort(owner, kind="stable")
        bins = bins[order]
        ends = np.searchsorted(owner[order], np.arange(high - low + 1))
        some = np.concatenate(([0], np.cumsum(letters > 0)))[begin]
        for i in range(high - low):
            if some[i] == some[i + 1] or not model.names:
                continue
            seen = np.bincount(bins[ends[i] : ends[i + 1]], minlength=BINS)
            own = np.flatnonzero(seen)
            found = mixture(model.chances[own], seen[own].astype(float))
            chosen, share = list(found), np.array(list(found.values()))
            gain = seen[own] @ np.log(model.chances[own][:, chosen] @ share * BINS) / seen.sum()
            fits[low + i] = float(gain / max(gains[chosen] @ share, 1e-9))
            top = max(found, key=lambda k: (found[k], -k))
            langs[low + i], scores[low + i] = model.names[top], min(1.0, max(0.0, found[top]))
            mixes[low + i] = ",".join(f"{model.names[k]}:{found[k]:.3f}" for k in sorted(found, key=lambda k: (-found[k], k)))
    return langs, scores, mixes, fits


def with_language(docs: DataFrame, model: Languages) -> DataFrame:
    """``docs`` with lang_pred, score and mixture (languages with proportions).

    A text that is null or has no letter is ``und`` with score 0; so is every text where no language was learned.
    Columns of ``docs`` with the names of new ones give way.
    """
    small_batches(docs.sparkSession)
    new = {"lang_pred": pa.string(), "score": pa.float64(), "mixture": pa.string()}
    docs = docs.drop(*new)
    kinds = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("mixture", StringType())])
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found = identify(texts, model)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(found, new.values(), strict=True))], [*batch.schema.names, *new])

    return docs.mapInArrow(run, kinds)


def accepted(docs: DataFrame, model: Languages, share: float = ACCEPTED_SHARE) -> DataFrame:
    """``docs`` in which one learned language has at least this share and whose n-grams fit the languages found.

    Others go: texts without letters, in languages never learned, or of scrambled letters, however many were learned.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            langs, scores, _, fits = fitted([t or "" for t in batch.column(place).to_pylist()], model)
            yield batch.filter(pa.array([lang != UNKNOWN and score >= share and fit >= LEAST_GAIN for lang, score, fit in zip(langs, scores, fits, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    out = held_out(F.col("doc_id"), 5, 0).alias("held_out")
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", out, "lang_pred", "score", "mixture")


QUERIES = {"op6_language_id": op6_language_id}
