"""Packing of token sequences into windows by best-fit decreasing."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm.numbering import number_within
from ledgerlens.session import write_table

WINDOW = 2048
END_ID = 1


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over 0..window that counts groups of windows.

    A leaf holds a stack of groups, each a run of window numbers with one
    remaining capacity.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = np.zeros(2 * self.leaves, np.int64)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += change
            node //= 2

    def push(self, capacity: int, first: int, windows: int) -> None:
        self.groups[capacity].append((first, windows))
        self._count(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return self.groups[capacity].pop()

    def tightest(self, needed: int) -> int | None:
        """The smallest capacity of at least `needed` that an open window has."""
        node = needed + self.leaves
        if self.open[node]:
            return needed
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


@dataclass
class Placement:
    """Pieces of one length, numbers first_piece to first_piece + windows * each - 1, go to windows one after another.

    Each window, from first_window on, gets `each` of them, from `offset` on.
    """

    length: int
    first_piece: int
    windows: int
    each: int
    first_window: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[Placement]:
    """Best-fit decreasing over all pieces, given how many there are of each length (1 to window).

    Pieces of one length are alike, and so are windows with one remaining
    capacity. A window that takes a piece stays the tightest as long as it
    has room for another of that length, so whole runs are placed at once and
    the result is that of placing piece by piece. The work depends on the
    number of lengths, not of pieces.
    """
    tree, plan, opened = CapacityTree(window), [], 0
    for length in sorted(counts, reverse=True):
        piece, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                first, windows, capacity = opened, -(-left // (window // length)), window
                opened += windows
            else:
                first, windows = tree.pop(capacity)
            each = capacity // length
            full, rest = min(windows, left // each), 0
            if full:
                plan.append(Placement(length, piece, full, each, first, window - capacity))
                if capacity > each * length:
                    tree.push(capacity - each * length, first, full)
            if full < windows and full * each < left:  # the last pieces go to one more window
                rest = left - full * each
                plan.append(Placement(length, piece + full * each, 1, rest, first + full, window - capacity))
                if capacity > rest * length:
                    tree.push(capacity - rest * length, first + full, 1)
            used = full + (rest > 0)
            if used < windows:
                tree.push(capacity, first + used, windows - used)
            piece += full * each + rest
            left -= full * each + rest
    return plan


# The pattern by which byte-level BPE files cut a text into pre-tokens (a fixed value of that format).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Cuts alike where no two blanks follow each other, and needs no look-ahead, which makes it faster.
PRE_TOKENS_SINGLE_BLANKS = PRE_TOKENS.replace(r"\s+(?!\S)|", "")
LONGEST_RUN = 100_000  # blanks in a row that tiktoken gets: its look-ahead takes stack for each, and fails at a million


def _byte_level_ranks(vocabulary: str) -> dict[bytes, int]:
    """Bytes and id of each token of a byte-level BPE file whose ids rise with the order of its merges."""
    model = json.loads(Path(vocabulary).read_text())["model"]
    ids = model["vocab"]
    merged = [ids["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")] for pair in model["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        raise ValueError(f"{vocabulary} is not a byte-level BPE file with ids in the order of its merges")
    # A byte stands for itself where it is visible in Latin-1, else for the next character from 256 on.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(byte): byte for byte in visible}
    signs |= {chr(256 + i): byte for i, byte in enumerate(sorted(set(range(256)) - set(visible)))}
    return {bytes(signs[c] for c in token): i for token, i in ids.items() if i < 256 + len(merged)}


def token_ids(vocabulary: str, added_tokens: bool = False) -> Callable[[str], list[int]]:
    """A function from a text to its ids, for a byte-level BPE file (the JSON of the library tokenizers).

    The ids are those of that library. Strings of added tokens, such as
    <|endoftext|>, are ordinary text, or with `added_tokens` what the library
    makes of them by default. Texts that hold such a string, or a run of
    blanks that tiktoken cannot take, are encoded by the library itself.
    """

    @cache  # the second encoding takes as much memory as the first, and many texts do without it
    def encoding(pattern: str) -> tiktoken.Encoding:
        ranks = _byte_level_ranks(vocabulary)
        return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cache  # few texts need it
    def library() -> Tokenizer:
        loaded = Tokenizer.from_file(vocabulary)
        loaded.encode_special_tokens = not added_tokens
        return loaded

    has_run = re.compile(r"\s\s").search
    runs = re.compile(r"\s\s+").finditer
    added = [token["content"] for token in json.loads(Path(vocabulary).read_text()).get("added_tokens") or []]
    has_added = re.compile("|".join(map(re.escape, added))).search if added and added_tokens else lambda text: None

    def encode(text: str) -> list[int]:
        blanks = has_run(text) is not None
        too_long = blanks and len(text) > LONGEST_RUN and any(run.end() - run.start() > LONGEST_RUN for run in runs(text))
        if too_long or has_added(text):
            return library().encode(text, add_special_tokens=False).ids
        return encoding(PRE_TOKENS if blanks else PRE_TOKENS_SINGLE_BLANKS).encode_ordinary(text)

    return encode


def cut(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, start, length, ids_crc32, doc_tokens and, if wanted, ids.

    A document is the ids of its text (null: empty), as the library gives
    them by default, and then END_ID. Full
    windows are cut off from its start; what is left is its last piece.
    ids_crc32 is the CRC of the ids as little-endian unsigned 32-bit numbers.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(vocabulary, added_tokens=True)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    row = (doc_id, start, len(piece), zlib.crc32(piece), len(ids))
                    rows.append((*row, piece.astype(np.int32)) if with_ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]
            columns = [list(column) for column in zip(*rows, strict=True)] or [[] for _ in names]
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            arrays = [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tokenize, schema)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: the columns of `cut`, sequence_id and offset.

    `docs` has doc_id and text. Best-fit decreasing runs on the driver over
    the counts per length, at most `window` numbers, and gives runs of pieces
    of one length; a piece finds its run by its number within its length. So
    the packing is that of one best-fit decreasing over the whole corpus,
    while no task sees more than its share of pieces. Documents with one
    doc_id, or none, and repeated rows are packed each. An empty table gives
    an empty one.
    """
    pieces = write_table(cut(docs, vocabulary, window, with_ids), "pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    plan = best_fit_decreasing(counts, window)
    runs: dict[int, list[tuple]] = {}
    for p in plan:
        runs.setdefault(p.length, []).append((p.first_piece, p.windows * p.each, p.each, p.first_window, p.offset))
    schema = "length long, runs array<struct<first: long, pieces: long, each: long, window: long, offset: long>>"
    table = F.broadcast(docs.sparkSession.createDataFrame(list(runs.items()), schema))
    numbered = number_within(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "_number").join(table, "length")
    inside = F.filter(
        "runs", lambda r: (r["first"] <= F.col("_number")) & (F.col("_number") < r["first"] + r["pieces"])
    )[0]
    return (
        numbered.withColumn("_run", inside)
        .withColumn("_at", F.col("_number") - F.col("_run.first"))
        .withColumn("sequence_id", F.col("_run.window") + F.expr("_at div _run.each"))
        .withColumn("offset", F.col("_run.offset") + F.col("_at") % F.col("_run.each") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The training rows (sequence_id, ids) of pieces packed with their ids.

    Rows are padded to the window, except those whose length is a power of two.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    short = F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))
    is_power = F.expr("bit_count(size(ids)) = 1")
    return (
        packed.groupBy("sequence_id")
        .agg(ids.alias("ids"))
        .withColumn("ids", F.when(is_power, F.col("ids")).otherwise(F.concat("ids", short)))
    )
