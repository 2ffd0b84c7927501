"""Packing: best fit against a plain loop, ids against the tokenizer library, and pieces that add up."""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from texts import prose

from ledgerlens.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    loaded = Tokenizer.from_file(VOCABULARY)
    loaded.encode_special_tokens = True
    return loaded


def _best_fit_one_by_one(lengths, window):
    rooms, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else window
        opened += at == len(rooms) and room == window
        if room > length:
            bisect.insort(rooms, room - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_placing_runs_equals_placing_piece_by_piece(seed):
    draw = random.Random(seed)
    window = draw.choice([1, 8, 13, 64, 100])
    lengths = [draw.randint(1, window) for _ in range(draw.randint(0, 300))]
    plan = packing.best_fit_decreasing(Counter(lengths), window)
    placed, used = Counter(), defaultdict(int)
    for run in plan:
        assert run.first_piece == placed[run.length]
        placed[run.length] += run.windows * run.each
        for number in range(run.first_window, run.first_window + run.windows):
            assert used[number] == run.offset
            used[number] += run.each * run.length
    assert placed == Counter(lengths)
    assert sorted(used) == list(range(len(used)))
    assert sorted(window - size for size in used.values() if size < window) == _best_fit_one_by_one(lengths, window)


def test_the_tightest_window():
    tree = packing.CapacityTree(20)
    for capacity in (3, 7, 20):
        tree.push(capacity, 0, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 7, 8, 20)] == [3, 3, 7, 7, 20, 20]
    tree.pop(20)
    assert tree.tightest(8) is None


def test_ids_are_those_of_the_tokenizer_library(tokenizer):
    encode = packing.token_ids(VOCABULARY)
    odd = ["", " ", "  a", "a ", " a\n b", "a  \n\n b", "it's <|endoftext|> 12 x", "　a  b\x1c c", "\U0001f600 ²½ a\tb "]
    draw = random.Random(2)
    odd += ["".join(draw.choice(" \n\ta b'st12é ") for _ in range(40)) for _ in range(500)] + [prose(1, 5000)]
    for text in odd:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


ROWS = [(i, prose(i, 3 + 37 * i % 900), "en") for i in range(60)]
ROWS += [(100, None, None), (101, "", "en"), (None, "no id", "en"), (None, "no id", "en"), (5, ROWS[5][1], "en"), (5, "other", "en")]
ROWS += [(200, prose(9, 30_000), "en")] + [(300 + i, "the same text", "en") for i in range(40)]


@pytest.fixture(scope="module")
def packed(spark):
    frame = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, lang string, length int")
    return packing.pack(frame, VOCABULARY, 256, with_ids=True).cache()


def test_each_id_lies_in_one_piece(packed, tokenizer):
    pieces = defaultdict(list)
    for row in packed.collect():
        assert row["length"] == len(row["ids"]) <= 256
        assert row["ids_crc32"] == zlib.crc32(np.array(row["ids"], "<u4").tobytes())
        pieces[row["doc_id"], row["doc_tokens"]].append((row["start"], row["ids"]))
    expected = defaultdict(list)
    for doc_id, text, _ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        expected[doc_id, len(ids)] += [(start, ids[start : start + 256]) for start in range(0, len(ids), 256)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}


def test_sequences_are_gapless_and_full(packed):
    used = defaultdict(list)
    for row in packed.collect():
        used[row["sequence_id"]].append((row["offset"], row["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(length for parts in used.values() for _, length in parts)
    assert sorted(used) == list(range(len(used)))
    assert len(used) == -(-total // 256)  # the best that is possible here


def test_training_rows_are_padded(packed):
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed, 256, pad_id=7).collect()}
    sizes = defaultdict(int)
    for row in packed.collect():
        sizes[row["sequence_id"]] += row["length"]
        assert rows[row["sequence_id"]][row["offset"] : row["offset"] + row["length"]] == row["ids"]
    for number, ids in rows.items():
        assert len(ids) == (sizes[number] if sizes[number].bit_count() == 1 else 256)


def test_an_empty_table(documents):
    assert packing.pack(documents([]), VOCABULARY).collect() == []


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y  ", "it's <|endoftext|", "<|ENDOFTEXT|>  <|endoftext|> \n"]


def test_ids_with_added_tokens_are_those_of_the_librarys_default_settings(spark):
    default = Tokenizer.from_file(VOCABULARY)
    expected = {i: default.encode(text, add_special_tokens=False).ids + [packing.END_ID] for i, text in enumerate(ADDED)}
    assert 50256 in expected[0]
    frame = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in packing.cut(frame, VOCABULARY, with_ids=True).collect()} == expected


@pytest.mark.parametrize("blank", ["\n", " ", "\t", "\u3000"])
def test_more_than_a_million_blanks_in_a_row(tokenizer, blank):
    text = f"it's  a{blank * 1_100_000}b <|endoftext|>"
    assert packing.token_ids(VOCABULARY)(text) == tokenizer.encode(text, add_special_tokens=False).ids
    with_added = packing.token_ids(VOCABULARY, added_tokens=True)(text)
    assert with_added == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    just_below = f"a{blank * packing.LONGEST_RUN}b"
    assert packing.token_ids(VOCABULARY)(just_below) == tokenizer.encode(just_below, add_special_tokens=False).ids
