"""Language identification by rank-order profiles.

A profile is the ranked list of a language's most frequent letter n-grams (1 to 3 letters, words padded
by blanks). A text's own most frequent n-grams are compared to each profile by the out-of-place
distance: the sum over them of the difference of the two ranks, or of the profile's length where the
profile lacks the n-gram. The nearest profile names the language.

Defined results: ``und`` with score 0 for a null text or one without a letter; ties between n-grams go
by their letters, ties between languages by name; with no labelled row everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: N-grams in a profile, and of a text that are compared.
TOP = 400
#: Characters whose n-grams are counted at a time. Bounds the temporary arrays, not the texts.
PART = 1 << 17
#: Labelled rows that profiles are learned from, for each language, about: a bounded sample.
SAMPLE = 2000
UNDETERMINED = "und"


class Profiles(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # sorted n-grams of all profiles
    ranks: np.ndarray  # a row for each n-gram, a column for each language
    top: int


def alphabet() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str, letters: np.ndarray, carry: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams, as numbers of up to three code points of 21 bits, that end in a part of a text, and its last two signs.

    ``carry``: the last two signs before the part; a run of other signs than letters is one blank.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = letters[code]
    before = np.concatenate([carry[-1:] != 32, letter[:-1]])[: len(code)]
    code = np.where(letter, code, 32)[letter | before]
    if last and (code[-1] if len(code) else carry[-1]) != 32:
        code = np.append(code, 32)
    code = np.concatenate([carry, code])
    blank = code == 32
    two = ~(blank[1:-1] & blank[2:])
    pairs = (code[:-1] << 21) | code[1:]
    triples = (pairs[:-1] << 21) | code[2:]
    inside = ~blank[1:-1] & (code[:-2] >= 0)
    return np.concatenate([code[2:][~blank[2:]], pairs[1:][two], triples[inside]]), code[-2:]


def _summed(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate([np.zeros(0, np.int64), *values]), return_inverse=True)
    return every, np.bincount(at, np.concatenate([np.zeros(0), *counts]), len(every)).astype(np.int64)


def counted(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text in order, and how often each occurs. ``PART`` characters are taken at a time."""
    text = text or ""
    carry = np.array([-1, 32])  # before the first sign is a blank, and nothing before that
    values, counts, held = [], [], 0
    for low in range(0, len(text), PART):
        own, carry = grams(text[low : low + PART], letters, carry, low + PART >= len(text))
        more, n = np.unique(own, return_counts=True)
        values.append(more)
        counts.append(n)
        held += len(more)
        if held > PART:
            total, n = _summed(values, counts)
            values, counts, held = [total], [n], 0
    return (values[0], counts[0]) if len(values) == 1 else _summed(values, counts)


def ranked(counts: np.ndarray, values: np.ndarray, top: int) -> np.ndarray:
    """The values with the highest counts, ties by value."""
    if len(values) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        counts, values = counts[counts >= least], values[counts >= least]
    return values[np.lexsort((values, -counts))][:top]


def classify(text: str | None, letters: np.ndarray, profiles: Profiles) -> tuple[str, float]:
    values, counts = counted(text, letters)
    if not len(values) or not profiles.languages:
        return UNDETERMINED, 0.0
    best = ranked(counts, values, profiles.top)
    at = np.minimum(np.searchsorted(profiles.grams, best), len(profiles.grams) - 1)
    known = profiles.grams[at] == best
    ranks = profiles.ranks[at[known]]
    apart = np.abs(ranks - np.flatnonzero(known)[:, None])
    missing = ranks == profiles.top
    far = np.where(missing, profiles.top, apart).sum(axis=0) + profiles.top * int((~known).sum())
    first = int(np.argmin(far))
    others = np.delete(far, first)
    least = int(others.min()) if len(others) else profiles.top * len(best)
    return profiles.languages[first], float(least / max(least + int(far[first]), 1))


def learn(labelled: DataFrame, text: str, lang: str, top: int = TOP) -> Profiles:
    """Profiles of the languages in a bounded table of labelled texts."""
    spark = labelled.sparkSession
    letters = spark.sparkContext.broadcast(alphabet())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a partition, of ``PART`` n-grams and more at a time."""
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for name, own in held.items():
                values, n = _summed(*map(list, zip(*own, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for body, name in zip(batch.column(0), batch.column(1), strict=True):
                held.setdefault(name.as_py(), []).append(counted(body.as_py(), letters.value))
                size += len(held[name.as_py()][-1][0])
                if size > 8 * PART:
                    yield from told()
                    size = 0
        yield from told()

    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL")
    sums = known.mapInArrow(partial, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    rows = sums.withColumn("place", place).filter(F.col("place") < top).select("lang", "gram", "place").toArrow()  # ``top`` rows a language
    names = sorted(rows["lang"].unique().to_pylist())
    lang_of, gram_of, place_of = np.array(rows["lang"].to_pylist(), object), rows["gram"].to_numpy(), rows["place"].to_numpy()
    tops = {name: gram_of[lang_of == name][np.argsort(place_of[lang_of == name])] for name in names}
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *tops.values()]))
    ranks = np.full((len(every), len(tops)), top, np.int16)
    for column, best in enumerate(tops.values()):
        ranks[np.searchsorted(every, best), column] = np.arange(len(best))
    return Profiles([*tops], every, ranks, top)


def bounded(labelled: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """About ``most`` rows of each label, chosen by a hash of the key: a sample, the same in every run."""
    share = F.floor(1_000_000 * F.least(F.lit(1.0), most / F.count("*")))
    shares = labelled.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("of_label")).agg(share.alias("share"))
    chosen = labelled.join(shares, F.col(label) == F.col("of_label"))
    return chosen.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) < F.col("share")).drop("of_label", "share")


def language(spark: SparkSession, profiles: Profiles, text: Column | str) -> Column:
    """struct(lang, score) of a text."""
    shared = spark.sparkContext.broadcast((alphabet(), profiles))

    def guess(texts: pa.Array) -> pa.Array:
        letters, known = shared.value
        found = [classify(t.as_py(), letters, known) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return F.arrow_udf(guess, "struct<lang: string, score: double>")(text)


def remainder(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key counts as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labelled = docs.filter((remainder("doc_id", 3) != 1) & F.col("lang").isNotNull())
    profiles = learn(bounded(labelled, "doc_id", "lang", SAMPLE), "text", "lang")
    guessed = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), language(spark, profiles, "text").alias("found"))
    return guessed.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
