"""Token counts of whole texts: huge ones in overlapping chunks that are spliced where both encodings provably agree."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.packing import token_ids
from ledgerlens.session import write_table

CHUNK = 16_384  # characters between the starts of two chunks; texts of up to as many are encoded at once
OVERLAP = 256  # characters that a chunk shares with the next one
WIDER = 16  # times the overlap where two chunks found no common boundary
MARKS = 4  # boundaries that either chunk reports of an overlap
LIMIT = 1024
KEY = ["digest", "other_digest"]  # two hashes of a text: equal texts are encoded once

# Characters that \s of the pattern matches (fixed values: Unicode's White_Space).
BLANKS = frozenset(
    "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


@cache
def kind(sign: str) -> str | None:
    """Which class of the byte-level pattern a character is in: blank, L(etter), N(umber) or sign.

    None where editions of Unicode differ, as the tokenizer's may be another than Python's.
    """
    if sign in BLANKS:
        return "blank"

    def group(category: str) -> str:
        return category[0] if category[0] in "LN" else "sign"

    now, before = unicodedata.category(sign), unicodedata.ucd_3_2_0.category(sign)
    certain = "Cn" not in (now, before) and now[0] != "Z" and before[0] != "Z" and not "\x1c" <= sign <= "\x1f"
    return group(now) if certain and group(now) == group(before) else None


def is_stable(before: str, after: str) -> bool:
    """Whether every text is cut into pre-tokens between two such neighbours, whatever stands around them.

    Each alternative of the pattern is one run of letters, of numbers, of
    other signs (each with a blank before it, if any) or of blanks, or a
    contraction. So no match goes on behind a character that is no blank into
    one of another class, but for an apostrophe with letters after it. And as
    the pattern looks behind nothing, the matches from there on are the same
    wherever the encoding began. Tokens never cross pre-tokens.
    """
    left, right = kind(before), kind(after)
    if left is None or right is None or left == right or left == "blank":
        return False
    return not (before == "'" and right == "L")


class Encoder:
    """Ids of a chunk, and the boundaries in it that hold for the whole text."""

    def __init__(self, vocabulary: str):
        self.encode = token_ids(vocabulary, added_tokens=True)
        content = json.loads(Path(vocabulary).read_text())
        self.added = [token["content"] for token in content.get("added_tokens") or []]
        # In a byte-level vocabulary each character of a token stands for a byte.
        lengths = {i: len(token) for token, i in content["model"]["vocab"].items()}
        lengths |= {token["id"]: len(token["content"].encode()) for token in content.get("added_tokens") or []}
        self.lengths = np.zeros(max(lengths) + 1, np.int64)
        self.lengths[list(lengths)] = list(lengths.values())
        self.margin = max([1, *map(len, self.added)])

    def ends(self, text: str) -> np.ndarray:
        """Where each token of a text ends, in characters; -1 where that is inside a character."""
        ids = np.array(self.encode(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        if text.isascii():
            return ends
        starts = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80  # of characters
        place = np.append(np.cumsum(starts) - starts, len(text))
        return np.where(np.append(starts, True)[ends], place[ends], -1)

    def marks(self, text: str, ends: np.ndarray, start: int, stop: int) -> list[tuple[int, int]]:
        """The first boundaries in text[start:stop] that are stable: place, and how many tokens end up to there.

        Nothing counts so near the edge that the string of an added token
        might lie across it, and nothing near such a string.
        """
        found: list[tuple[int, int]] = []
        first, last = np.searchsorted(np.maximum.accumulate(ends), (start + self.margin, stop - self.margin + 1))
        for token in range(first, last):
            place = int(ends[token])
            if place < 0 or place >= len(text) or not is_stable(text[place - 1], text[place]):
                continue
            around = text[max(place - self.margin, 0) : place + self.margin]
            if any(added in around for added in self.added):
                continue
            found.append((place, token + 1))
            if len(found) == MARKS:
                break
        return found


def starts_of(length: int, chunk: int, overlap: int) -> range:
    """Where the chunks of a text start; the last is longer than the overlap."""
    return range(0, max(length - overlap, 1), chunk)


def _pieces(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of texts (digest, other_digest, text): number, chunks, start, text; spread, and once for equal texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                digest, other, text = (batch.column(c)[row].as_py() for c in (*KEY, "text"))
                starts = starts_of(len(text), chunk, overlap)
                for some in range(0, len(starts), 64):
                    part = starts[some : some + 64]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "digest": pa.array([digest] * len(part), pa.int64()),
                            "other_digest": pa.array([other] * len(part), pa.int64()),
                            "number": pa.array(range(some, some + len(part)), pa.int32()),
                            "chunks": pa.array([len(starts)] * len(part), pa.int32()),
                            "text": [
                                text[s : s + chunk + overlap] if some + i + 1 < len(starts) else text[s:]
                                for i, s in enumerate(part)
                            ],
                        }
                    )

    schema = "digest long, other_digest long, number int, chunks int, text string"
    return texts.mapInArrow(cut, schema).groupBy(*KEY, "number", "chunks").agg(F.first("text").alias("text"))


def _marks(pieces: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """Encoded chunks as rows (digest, other_digest, chunks, seam, place, tokens).

    `seam` is the chunk before it; `place` lies in the overlap there. `tokens`
    is how many tokens of the chunk before end up to the place, or less how
    many of the chunk behind do. The last chunk adds a row without seam that has all its tokens.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for row in range(batch.num_rows):
                *key, number, chunks, text = (batch.column(c)[row].as_py() for c in (*KEY, "number", "chunks", "text"))
                ends = encoder.ends(text)
                if number:
                    marks = encoder.marks(text, ends, 0, overlap)
                    rows += [(*key, chunks, number - 1, place, -tokens) for place, tokens in marks]
                if number + 1 < chunks:
                    marks = encoder.marks(text, ends, chunk, chunk + overlap)
                    rows += [(*key, chunks, number, place - chunk, tokens) for place, tokens in marks]
                else:
                    rows.append((*key, chunks, None, None, len(ends)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*KEY, "chunks", "seam", "place", "tokens"])

    schema = "digest long, other_digest long, chunks int, seam int, place long, tokens long"
    return pieces.mapInArrow(encode, schema)


def _spliced(marks: DataFrame) -> DataFrame:
    """Tokens of each text (digest, other_digest, n_tokens, open): `open` of its seams have no common boundary.

    Up to a common boundary the chunk before counts, from there on the one
    behind: each seam adds the difference of what both have up to there.
    """
    places = (
        marks.groupBy(*KEY, "seam", "place")
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("sides"), F.max("chunks").alias("chunks"))
        .filter("seam is null or sides = 2")
    )
    seams = places.groupBy(*KEY, "seam").agg(
        F.min_by("tokens", F.coalesce("place", F.lit(0))).alias("tokens"), F.max("chunks").alias("chunks")
    )
    return seams.groupBy(*KEY).agg(
        F.sum("tokens").alias("n_tokens"), (F.max("chunks") - 1 - F.count("seam")).alias("open")
    )


def huge_counts(texts: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """n_tokens of each distinct text of `texts` (digest, other_digest, text), from overlapping chunks.

    Chunks of one text are encoded by many tasks. Where an overlap has no
    stable boundary, as inside a run of letters that is longer, the text is
    cut anew with wider overlaps, until one chunk holds it whole.
    """
    done: DataFrame | None = None
    left = texts
    while True:
        marks = _marks(_pieces(left, chunk, overlap), vocabulary, chunk, overlap)
        spliced = write_table(_spliced(marks), "token-counts")
        whole = spliced.filter("open = 0").select(*KEY, "n_tokens")
        done = whole if done is None else done.unionByName(whole)
        failed = spliced.filter("open > 0").select(*KEY)
        if failed.isEmpty():
            return done
        left = texts.join(failed, KEY, "left_semi")
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than `limit`).

    `docs` has doc_id and text; `vocabulary` is a byte-level BPE file of the
    library tokenizers, and tokens are what that gives for the whole text
    without added special tokens (strings of special tokens in a text as by
    default). Null and empty texts have none; repeated rows, and rows with one
    doc_id or none, are counted each; other columns are not looked at; an empty
    table gives an empty one. A text of more than `chunk` characters is
    never encoded in one piece unless it lacks a stable boundary over longer
    and longer stretches, so memory is bounded by the chunk, not the text.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("n_bytes", F.octet_length("text").cast("bigint"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(vocabulary, added_tokens=True)
        for batch in batches:
            tokens = [len(encode(text.as_py())) for text in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    short = texts.filter(F.length("text") <= chunk).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    huge = texts.filter(F.length("text") > chunk).withColumns(
        {"digest": F.xxhash64("text"), "other_digest": F.xxhash64(F.lit(1), "text")}
    )
    counts = huge_counts(huge.select(*KEY, "text"), vocabulary, chunk, overlap)
    long = huge.select("doc_id", "n_bytes", *KEY).join(counts, KEY).select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
