"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import write_table

UNKNOWN = "und"
PROFILE_SIZE = 400  # ranks kept per language and per document
SAMPLE_SIZE = 3000  # training documents per language
LANGUAGES = 1000  # that profiles are learned for, at most
_TOGETHER = 128  # documents whose n-grams are counted together
_POINTS = 1 << 20  # code points of a text whose n-grams are counted together
_BITS = 21  # a code point; three fit in 63 bits
_CODE_POINTS = 0x110000


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_CODE_POINTS)), bool, _CODE_POINTS)


def _grams(points: np.ndarray, is_letter: np.ndarray) -> np.ndarray:
    """Codes of all 1- to 3-grams of the words, each word with a blank on both sides.

    Whatever is not a letter separates words. Empty if there is no letter.
    """
    if not is_letter.any():
        return np.empty(0, np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank after each word
    line = np.where(is_letter, points, 32)[keep].astype(np.int64)
    line = np.concatenate(([32], line, [32]) if line[-1] != 32 else ([32], line))
    pairs = (line[:-1] << _BITS) | line[1:]
    triples = (pairs[:-1] << _BITS) | line[2:]
    middle = line[1:-1]
    # No gram spans two words: a blank is never inside, and alone it says nothing.
    return np.concatenate((line[line != 32], pairs, triples[middle != 32]))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with the sum of its counts."""
    once, place = np.unique(codes, return_inverse=True)
    return once, np.bincount(place, counts, len(once)).astype(np.int64)


def gram_counts(texts: Iterable[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some texts in lower case, and how often they stand there.

    Long texts are taken in pieces that end between words, so memory is bounded by the
    number of different n-grams and the longest word. Short ones are counted together.
    """
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting: list[np.ndarray] = []
    for text in texts:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        start = 0
        while start < len(points):
            end = min(start + _POINTS, len(points))
            while end < len(points) and letter[points[end - 1]]:  # to the end of the word
                after = points[end : end + _POINTS]
                others = np.flatnonzero(~letter[after])
                end += int(others[0]) + 1 if len(others) else len(after)
            waiting.append(_grams(points[start:end], letter[points[start:end]]))
            start = end
            if sum(map(len, waiting)) > 4 * _POINTS:
                some, each = np.unique(np.concatenate(waiting), return_counts=True)
                codes, counts = _summed(np.concatenate((codes, some)), np.concatenate((counts, each)))
                waiting = []
    some, each = np.unique(np.concatenate([*waiting, np.empty(0, np.int64)]), return_counts=True)
    return (some, each) if not len(codes) else _summed(np.concatenate((codes, some)), np.concatenate((counts, each)))


def _ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The codes by falling count, then by code; at most `size`."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:size]


def top_grams(text: str, letter: np.ndarray, size: int) -> np.ndarray:
    return _ranked(*gram_counts([text], letter), size)


class Profiles:
    """The ranked n-grams of each language; languages * size * 16 bytes in all.

    `left_out` is how many languages there were beyond those that profiles are learned for.
    """

    def __init__(self, ranked: dict[str, np.ndarray], size: int, left_out: int = 0):
        self.languages = sorted(ranked)
        self.size, self.left_out = size, left_out
        self.codes = np.unique(np.concatenate([ranked[name] for name in self.languages] or [np.empty(0, np.int64)]))
        # The last row stands for n-grams that no profile has.
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int32)
        for column, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, ranked[name]), column] = np.arange(len(ranked[name]))

    def predict(self, text: str | None, letter: np.ndarray) -> tuple[str, float]:
        """The language at the smallest out-of-place distance, and 1 minus that distance's share of the largest."""
        top = top_grams(text, letter, self.size) if text else np.empty(0, np.int64)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        ranks = self.ranks[at]
        moved = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None]))
        distance = moved.sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(top))


def learn(
    labelled: DataFrame, size: int = PROFILE_SIZE, sample: int = SAMPLE_SIZE, languages: int = LANGUAGES
) -> Profiles:
    """Profiles from rows (doc_id, text, lang): n-gram counts over about `sample` documents per language.

    Profiles are learned for the `languages` that most rows have (of equally frequent ones
    the first by name); the number of others is told in `left_out`, and logged.

    The sample is by hash of doc_id and text, so it depends on the rows
    alone. Rows without text or language are left out; without any row there
    are no languages. The driver gets the first `size` n-grams of each
    language, and the broadcast table has a row for each. Texts are not shuffled.
    """
    usable = labelled.filter("text is not null and lang is not null")
    sizes = write_table(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    left_out = max(sizes.count() - languages, 0)
    if left_out:
        logging.getLogger(__name__).warning("no profiles for %d languages beyond the %d most frequent", left_out, languages)
    share = (F.lit(float(sample)) / F.col("n")).alias("share")
    shares = sizes.orderBy(F.col("n").desc(), "lang").limit(languages).select("lang", share)
    uniform = (F.xxhash64("doc_id", "text").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    chosen = usable.select("lang", "text", uniform.alias("draw")).join(F.broadcast(shares), "lang").filter("draw < share")
    packed = np.packbits(_letters())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.unpackbits(packed).astype(bool)
        parts = (batch.slice(start, _TOGETHER) for batch in batches for start in range(0, batch.num_rows, _TOGETHER))
        for part in parts:
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for name in sorted(set(langs)):
                codes, counts = gram_counts([text for text, lang in zip(texts, langs, strict=True) if lang == name], letter)
                columns = {"lang": pa.array([name] * len(codes), pa.string()), "gram": codes, "n": counts}
                yield pa.RecordBatch.from_pydict(columns)

    counted = (
        chosen.select("lang", "text")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    ranked: dict[str, list[int]] = {}
    for row in counted.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("lang", "rank").collect():
        ranked.setdefault(row["lang"], []).append(row["gram"])
    return Profiles({name: np.array(grams, np.int64) for name, grams in ranked.items()}, size, left_out)


def identify(text: Column, profiles: Profiles) -> Column:
    """A struct (lang, score) of a text: UNKNOWN and 0 if it is null or has no letter.

    Only the whole text goes to Python. Of languages at the same distance the
    first by name is taken.
    """
    packed = np.packbits(_letters())

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letter = np.unpackbits(packed).astype(bool)
        for batch in texts:
            yield pd.DataFrame([profiles.predict(t, letter) for t in batch], columns=["lang", "score"])

    return predict(text)
