"""Token counts against the library on whole texts; chunks meet only at boundaries that hold for any text."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import prose
from tokenizers import Tokenizer

from ledgerlens.llm import token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
ENCODER = token_counts.Encoder(VOCABULARY)


def _library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def _odd(seed: int, length: int) -> str:
    draw = random.Random(seed)
    parts = ["word", "it's", "we'll", "'", "''s", " ", "  ", "\n", "\t\n ", "12", "3.5", "é", "日本語", "。", "😀", "é",
             "<|endoftext|>", "<|endof", "text|>", "\u200b", "\x1c", "\u3000", "...", "x" * 30, "\xa0", "ٱلْ", "'ll", "ſ"]
    out: list[str] = []
    while sum(map(len, out)) < length:
        out.append(draw.choice(parts))
    return "".join(out)


PIECES = st.lists(
    st.sampled_from(["a", "B", "'", "s", "ll", " ", "  ", "\n", "7", ".", "é", "本", "。", "́", "😀", "<|endoftext|>", "\x85"]),
    max_size=14,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_a_stable_boundary_splits_the_encoding(left, right):
    if not left or not right or not token_counts.is_stable(left[-1], right[0]) or "<|" in left[-13:] + right[:13]:
        return
    both = LIBRARY.encode(left + right, add_special_tokens=False).ids
    assert both == [i for part in (left, right) for i in LIBRARY.encode(part, add_special_tokens=False).ids]


def test_kinds_of_neighbours():
    assert token_counts.is_stable("a", " ") and token_counts.is_stable("a", "1") and token_counts.is_stable(".", "a")
    assert not token_counts.is_stable("'", "s")  # a contraction
    assert not token_counts.is_stable(" ", "a") and not token_counts.is_stable(" ", "\n")
    assert not token_counts.is_stable("a", "b") and not token_counts.is_stable("a", "\u200b")  # no blank any more
    assert not token_counts.is_stable("a", "\U0001fae0")  # younger than some editions


@pytest.mark.parametrize("seed", range(6))
def test_ends_of_tokens(seed):
    text = _odd(seed, 300)
    ends = ENCODER.ends(text)
    assert len(ends) == _library(text) and ends[-1] == len(text)
    assert all((np.diff(ends[ends >= 0]) >= 0))


def test_marks_keep_off_added_tokens():
    text = "one two <|endoftext|> three four five six seven"
    marks = ENCODER.marks(text, ENCODER.ends(text), 0, len(text))
    assert marks and all(not 8 <= place <= 21 for place, _ in marks)


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 60), (64, 40), (1000, 64)])
def test_chunked_counts_are_the_librarys(spark, documents, chunk, overlap):
    texts = [_odd(seed, 3000) for seed in range(6)] + [prose(1, 500), "z" * 5000, " " * 3000, "ab " * 900, "日本" * 700, "'" * 999]
    texts += ["a" * 199 + "<|endoftext|>" * 90 + "b" * 500, None, "", "x", texts[0]]
    docs = documents([(i, text, "en") for i, text in enumerate(texts)], extra=True)
    found = {row["doc_id"]: row for row in token_counts.count_tokens(docs, VOCABULARY, 100, chunk, overlap).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        tokens = _library(text)
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((text or "").encode()), tokens, tokens > 100)


def test_a_failing_overlap_is_widened(spark, monkeypatch):
    rounds = []
    cut = token_counts._pieces

    def counted(texts, chunk, overlap):
        rounds.append((chunk, overlap, texts.count()))
        return cut(texts, chunk, overlap)

    monkeypatch.setattr(token_counts, "_pieces", counted)
    texts = [prose(3, 400), "q" * 3000 + " end " + "r" * 400]
    frame = spark.createDataFrame([(i, i, text) for i, text in enumerate(texts)], "digest long, other_digest long, text string")
    found = {row["digest"]: row["n_tokens"] for row in token_counts.huge_counts(frame, VOCABULARY, 100, 50).collect()}
    assert found == {i: _library(text) for i, text in enumerate(texts)}
    assert rounds == [(100, 50, 2), (3200, 800, 1)]  # only the text that failed is cut anew


def test_long_texts_are_spread_and_copies_encoded_once(spark):
    text = prose(5, 20_000)
    frame = spark.createDataFrame([(1, 2, text)] * 7, "digest long, other_digest long, text string")
    pieces = token_counts._pieces(frame, 1000, 100).cache()
    assert pieces.count() == len(token_counts.starts_of(len(text), 1000, 100))
    assert pieces.selectExpr("count(distinct number)").first()[0] == pieces.count()


def test_repeated_rows_missing_ids_and_no_rows(spark, documents):
    docs = documents([(None, "a b c", "en"), (None, "a b c", "en"), (3, prose(1, 9000), None), (3, prose(1, 9000), None)])
    found = token_counts.count_tokens(docs, VOCABULARY)
    long = _library(prose(1, 9000))
    rows = sorted(map(tuple, found.collect()), key=str)
    assert rows == sorted([(None, 5, 3, False)] * 2 + [(3, len(prose(1, 9000)), long, True)] * 2, key=str)
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).collect() == []
