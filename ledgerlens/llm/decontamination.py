"""Benchmark decontamination: BM25 retrieval of test items for each passage, then overlap of question and answer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bm25 import Index
from ledgerlens.session import write_table

STRIDE = 64  # words of an index entry at most; passages are twice as long, so one holds any entry whole
PASSAGE = 2 * STRIDE
PASSAGES = 512  # that are searched for in step
THRESHOLD = 0.6  # share of an entry's BM25 weight that a passage must hold
SHINGLE = 5
OVERLAP = 0.8  # share of an item's shingles, in question and answer each, that a document must hold
LEAST_WORDS = 8  # shorter items must be there whole, word after word
SHARD_CHARS = 4_000_000  # characters of test items in one broadcast index
_WORD = re.compile(r"[^\W_]+")
# Scripts that put no blank between words (Thai, Lao, Burmese, Khmer, Tai, Balinese, Javanese, kana, bopomofo, Han).
_BLANKLESS = (
    r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\ua980-\ua9ff\uaa60-\uaadf"
    r"\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
    r"\U0001b000-\U0001b16f\U00020000-\U000323af"
)
_HAS_BLANKLESS = re.compile(f"[{_BLANKLESS}]").search
_WORD_OR_SIGN = re.compile(rf"[^\W_{_BLANKLESS}]+|(?=[^\W_])[{_BLANKLESS}]")
LONG_TEXT = 1_000_000
_STRETCH = re.compile(rf"(?s).{{1,{LONG_TEXT}}}(?:[^\W_]+|\Z|)")  # ends behind a word
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; in scripts without blanks each sign is a word."""
    lower = (text or "").lower()
    return (_WORD if lower.isascii() or not _HAS_BLANKLESS(lower) else _WORD_OR_SIGN).findall(lower)


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last line, or of one line the last sentence; an item of one sentence is all question."""
    parts = [line for line in text.splitlines() if words_of(line)]
    if len(parts) == 1:
        parts = [sentence for sentence in _SENTENCE.split(parts[0]) if words_of(sentence)]
    answer = parts[-1:] if len(parts) > 1 else []
    return words_of(" ".join(parts[: len(parts) - len(answer)])), words_of(" ".join(answer))


def _sides(text: str) -> tuple[list[str], list[str]]:
    """Question and answer; the words of a short item are all question."""
    words = words_of(text)
    return (words, []) if len(words) < LEAST_WORDS else question_and_answer(text)


def _entries(text: str) -> list[list[str]]:
    """What is indexed of an item: question and answer apart, in parts of STRIDE words at most; a short item whole."""
    entries = []
    for side in filter(None, _sides(text)):
        parts = -(-len(side) // STRIDE)
        entries += [side[len(side) * i // parts : len(side) * (i + 1) // parts] for i in range(parts)]
    return entries


def _hashes(number: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` numbers."""
    number = number.astype(np.int64)
    runs, bits = max(len(number) - size + 1, 0), number.view(np.uint64)
    found = bits[:runs].copy()
    for i in range(1, size):
        found *= np.uint64(0x9E3779B97F4A7C15)
        found += bits[i : i + runs]
    return found


def _runs(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of `size` words (of fewer, all of them as one), and their hashes."""
    if not len(words):
        return words[:, None], np.empty(0, np.uint64)
    runs = np.unique(np.lib.stride_tricks.sliding_window_view(words, min(size, len(words))), axis=0)
    return runs, np.concatenate([_hashes(run, len(run)) for run in runs])


class _Held:
    """The runs of a document's words (as numbers), to look up which of given ones it holds."""

    def __init__(self, number: np.ndarray):
        self.number = number
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def share(self, runs: np.ndarray, hashes: np.ndarray) -> float:
        """The share of the runs that stand in the document; 1 without any. If too small anyhow, that of their hashes."""
        if not len(runs):
            return 1.0
        size = runs.shape[1]
        if len(self.number) < size:
            return 0.0
        if size not in self.by_size:
            own = _hashes(self.number, size)
            order = np.argsort(own, kind="stable")
            self.by_size[size] = own[order], order
        own, order = self.by_size[size]
        first = np.searchsorted(own, hashes)
        alike = own[np.minimum(first, len(own) - 1)] == hashes
        if alike.mean() < OVERLAP - 1e-9:
            return float(alike.mean())
        count = 0
        for run, place in zip(runs[alike], first[alike].tolist(), strict=True):
            # The hash finds the place, the words decide; runs with one hash follow one another.
            start = place
            while place < len(own) and own[place] == own[start]:
                if (self.number[order[place] : order[place] + size] == run).all():
                    count += 1
                    break
                place += 1
        return count / len(runs)


@dataclass
class Shard:
    """An index of the entries of some items, with the items' words as numbers of terms.

    `owner` is the item that an entry is a part of. The words of item i are
    those from words[starts[i]] to words[ends[i]], its answer those from words[answers[i]] on.
    """

    index: Index
    owner: np.ndarray
    item_id: list[int | None]
    words: np.ndarray
    starts: np.ndarray
    answers: np.ndarray
    ends: np.ndarray
    runs: dict[int, tuple] = field(default_factory=dict)  # of items that came up

    @classmethod
    def of(cls, items: list[tuple[int | None, str]], frequency: Mapping[str, int], entries: int, mean: float) -> Shard:
        """`frequency`, `entries` and `mean` (words of an entry) are those of all shards together."""
        cut = [(owner, entry) for owner, (_, text) in enumerate(items) for entry in _entries(text)]
        index = Index([entry for _, entry in cut], frequency, entries, mean)
        words, starts, answers = [], [], []
        for _, text in items:
            question, answer = _sides(text)
            starts.append(len(words))
            answers.append(len(words) + len(question))
            words += [index.terms[word] for word in (*question, *answer)]
        return cls(
            index,
            np.array([owner for owner, _ in cut], np.int32),
            [item_id for item_id, _ in items],
            np.array(words, np.int32),
            np.array(starts, np.int64),
            np.array(answers, np.int64),
            np.array([*starts[1:], len(words)], np.int64),
        )

    def overlaps(self, held: _Held, item: int) -> tuple[float, float]:
        """Shares of the runs of an item's question and answer (1 without answer) that a document holds."""
        if item not in self.runs:
            start, answer, end = (int(bound[item]) for bound in (self.starts, self.answers, self.ends))
            size = end - start if end - start < LEAST_WORDS else SHINGLE
            self.runs[item] = _runs(self.words[start:answer], size), _runs(self.words[answer:end], size)
        question, answer = self.runs[item]
        return held.share(*question), held.share(*answer)

    def leaks(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int | None, float, float, float]]]:
        """For each text (item_id, score, question overlap, answer overlap) of each item that it holds.

        Every passage of every text queries the index, and all entries above the threshold
        come back. The items these are parts of are then verified: the
        document as a whole has to pass the overlap check of question and answer.
        """
        numbers: list[np.ndarray] = []  # words of the texts that are not verified yet
        best: list[dict[int, float]] = []
        rows: list[np.ndarray] = []  # passages that are not searched for yet
        texts_of: list[np.ndarray] = []

        def search() -> None:
            passage, entry, score = self.index.search(np.concatenate(rows), THRESHOLD)
            text = np.concatenate(texts_of)[passage]
            for own, owner, found in zip(text.tolist(), self.owner[entry].tolist(), score.tolist(), strict=True):
                best[own][owner] = max(best[own].get(owner, 0.0), found)
            rows.clear()
            texts_of.clear()

        def verified() -> Iterator[list[tuple[int | None, float, float, float]]]:
            for number, scores in zip(numbers, best, strict=True):
                held, leaks = _Held(number), []
                for owner, score in sorted(scores.items()):
                    shares = self.overlaps(held, owner)
                    if min(shares) >= OVERLAP - 1e-9:
                        leaks.append((self.item_id[owner], score, *shares))
                yield leaks
            numbers.clear()
            best.clear()

        for text in texts:
            number = self._numbers(text)
            passages = max(-(-(len(number) - STRIDE) // STRIDE), 1)
            padded = np.full((passages + 1) * STRIDE, -1, np.int32)
            padded[: len(number)] = number
            numbers.append(number)
            best.append({})
            windows = np.lib.stride_tricks.sliding_window_view(padded, PASSAGE)[::STRIDE]
            for some in range(0, passages, PASSAGES):
                rows.append(windows[some : some + PASSAGES])
                texts_of.append(np.full(len(rows[-1]), len(numbers) - 1))
                if sum(map(len, rows)) >= PASSAGES:
                    search()
            if not rows:
                yield from verified()
        if rows:
            search()
        yield from verified()

    def _numbers(self, text: str | None) -> np.ndarray:
        """The words of a text as numbers of terms, -1 for others. Words of a long text are never held all at once."""
        pieces = [text or ""]
        if len(pieces[0]) > LONG_TEXT:
            pieces = (match.group() for match in _STRETCH.finditer(pieces[0]))
        known = self.index.terms.get
        found = [np.fromiter(map(known, words, repeat(-1)), np.int32, len(words)) for words in map(words_of, pieces)]
        return np.concatenate(found) if found else np.empty(0, np.int32)


def shards(benchmark: DataFrame, shard_chars: int = SHARD_CHARS) -> Iterator[Shard]:
    """Indexes of all items that have a word, each of some `shard_chars` characters.

    Frequencies of terms are counted by Spark over all items; the driver
    holds the items and the terms of one shard at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [t for text in batch.column("text").to_pylist() for entry in _entries(text) for t in {*entry}]
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string())})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_entries(text) for text in batch.column("text").to_pylist()]
            words = pa.array([sum(map(len, entries)) for entries in cut], pa.int64())
            entries = pa.array([len(entries) for entries in cut], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, words, entries], ["item_id", "text", "n_words", "n_entries"])

    given = benchmark.filter("text is not null").select(F.col("item_id").cast("bigint"), "text")
    items = write_table(
        given.mapInArrow(measure, "item_id long, text string, n_words long, n_entries long").filter(F.col("n_words") > 0),
        "test-items",
    )
    size = items.agg(F.sum(F.length("text")), F.sum("n_words"), F.sum("n_entries")).first()
    if size[0] is None:
        return
    chars, words, entries = map(int, size)
    frequency = write_table(
        items.mapInArrow(count, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "test-terms"
    )
    parts = chars // shard_chars + 1
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = own.orderBy("item_id", "text").collect()
        held = own.mapInArrow(count, "term string").distinct()
        known = {row["term"]: row["n"] for row in frequency.join(held, "term").collect()}
        yield Shard.of([(row["item_id"], row["text"]) for row in rows], known, entries, words / entries)


LEAKS = "array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double>>"


def _leaks(docs: DataFrame, shard: Shard) -> Column:
    """The items of a shard that a document's text holds; the shard is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(shard)
    names = ("item_id", "score", "question_overlap", "answer_overlap")

    @F.pandas_udf(LEAKS)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[dict(zip(names, leak, strict=True)) for leak in leaks] for leaks in shared.value.leaks(batch)])

    return search(F.col("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    `docs` has doc_id and text, `benchmark` item_id and text. An item is found
    if a passage holds enough of the weight of its question or of its answer
    (or of a part of a long one), wherever the other stands, and the document
    as a whole passes the overlap check of both; an item
    of fewer than LEAST_WORDS words must be there whole, word after word. Each
    row of `docs` is judged on its own, so rows with one doc_id, or none, can
    give the same row several times, as can items with one item_id. Null and
    empty texts hold nothing, and an empty table gives an empty one.
    Documents are not shuffled; the index is broadcast in shards of bounded
    size, and documents pass once per shard.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    searched = [
        texts.select("doc_id", _leaks(docs, shard).alias("leaks")) for shard in shards(benchmark, shard_chars)
    ] or [texts.select("doc_id", F.lit(None).cast(LEAKS).alias("leaks"))]
    return reduce(DataFrame.union, searched).select("doc_id", F.inline("leaks"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """`docs` without the rows whose text holds a test item, as `find_leaks` tells; all columns as they are."""
    for shard in shards(benchmark, shard_chars):
        docs = docs.filter(F.size(_leaks(docs, shard)) == 0)
    return docs
