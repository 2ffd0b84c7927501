"""Substring dedup: automata against plain search, and removal against a window dictionary."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from texts import prose

from ledgerlens.llm import substrings
from ledgerlens.llm.automaton import SuffixAutomaton


@pytest.mark.parametrize("seed", range(40))
def test_owners_of_windows_against_plain_search(seed):
    draw = random.Random(seed)
    letters = "ab" if seed % 2 else "abcd"
    segments = sorted(
        (draw.randrange(5), [draw.choice(letters) for _ in range(draw.randrange(1, 30))]) for _ in range(draw.randrange(1, 8))
    )
    text = [draw.choice(letters + "z") for _ in range(200)]
    for window in (1, 2, 4, 7):
        first = {}
        for owner, words in segments:
            for i in range(len(words) - window + 1):
                first.setdefault(tuple(words[i : i + window]), owner)
        expected = [
            (i + window - 1, first[tuple(text[i : i + window])])
            for i in range(len(text) - window + 1)
            if tuple(text[i : i + window]) in first
        ]
        assert list(SuffixAutomaton(segments).owners(text, window)) == expected


def _by_force(rows, window):
    """(words, kept words) of each row, in order of doc_id, none last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, out = {}, {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    place = [(rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows))]
    for i in order:
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), place[i])
    for i in order:
        keep = [True] * len(words[i])
        for k in range(len(words[i]) - window + 1):
            if first[tuple(words[i][k : k + window])] < place[i]:
                keep[k : k + window] = [False] * window
        out[i] = (words[i], [w for w, kept in zip(words[i], keep, strict=True) if kept])
    return [out[i] for i in range(len(rows))]


PASSAGES = [prose(i, n) for i, n in enumerate([50, 51, 80, 49, 300])]


def _rows(seed):
    draw = random.Random(seed)
    rows = [(i, "\n".join([prose(1000 * seed + i, draw.randrange(70)), draw.choice(PASSAGES), prose(7 * i + 10**6, 9)])) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (2, rows[3][1]), (102, PASSAGES[4]), (103, " ".join(PASSAGES))]
    # A shared passage in other surroundings each time, edited by one word, and within one document only.
    rows += [(110 + i, f"x{i} " + PASSAGES[4].replace(" w", f" y{i}w", 1) + f" z{i}") for i in range(12)]
    rows += [(130, " ".join([prose(5, 60)] * 2)), (131, "a " * 200), (132, "a " * 49), (133, "a " * 500 + "b")]
    rows += [(140, None), (141, ""), (142, " \t "), (None, rows[5][1]), (None, prose(77, 90)), (None, prose(77, 90))]
    rows += [(150, "Wort " + PASSAGES[2].replace(" ", "  ")), (0, prose(99, 3000)), (151, prose(99, 3000) + " end")]
    draw.shuffle(rows)
    return rows


def _sha(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


@pytest.mark.parametrize(("seed", "shard"), [(1, 100_000), (2, 60)])
def test_removal_against_a_window_dictionary(documents, monkeypatch, seed, shard):
    """Also with a reference of many shards, stretches that are cut, and several streams."""
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    if shard == 60:
        monkeypatch.setattr(substrings, "STRETCH_WORDS", 20)
        monkeypatch.setattr(substrings, "STREAM_WORDS", 500)
    rows = _rows(seed)
    found = substrings.dedup_digest(documents([(i, t, "en") for i, t in rows], extra=True)).collect()
    expected = [(i, len(w), len(w) - len(k), _sha(k)) for (i, _), (w, k) in zip(rows, _by_force(rows, 50), strict=True)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert sum(r["n_removed"] > 0 for r in found) > 40


def test_texts_lose_what_the_digest_says(documents):
    rows = _rows(3)
    docs = documents([(i, t, "en") for i, t in rows], extra=True)
    kept = substrings.dedup(docs)
    assert kept.columns == docs.columns
    expected = []
    for (i, text), (words, left) in zip(rows, _by_force(rows, 50), strict=True):
        if len(left) == len(words):
            expected.append((i, text))
        elif left:
            expected.append((i, " ".join(left)))
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(map(repr, expected))


def test_only_stretches_under_shared_anchors_go_on(spark, documents):
    """Of a long document with one shared passage, little more than that passage is moved."""
    long = f"{prose(41, 30_000, 10**6)} {PASSAGES[4]} {prose(42, 30_000, 10**6)}"
    docs = documents([(1, f"{prose(43, 200, 10**6)} {PASSAGES[4]} {prose(44, 40, 10**6)}", "en"), (2, long, "en")])
    shared = substrings.sketches(docs, 50, 16).select("doc", "digest", F.explode("anchors").alias("anchor"))
    both = shared.groupBy("anchor").agg(F.collect_list("doc").alias("docs")).filter(F.size("docs") > 1)
    lists = shared.join(both, "anchor").groupBy("doc", "digest").agg(F.collect_set("anchor").alias("shared"))
    texts = docs.select(F.col("doc_id").alias("doc"), substrings.text_digest().alias("digest"), "text").join(lists, ["doc", "digest"])
    stretches = substrings._stretches(texts, 50, 16).filter("doc = 2").collect()
    assert 300 <= sum(len(row["words"].split(" ")) for row in stretches) <= 450
    row = substrings.dedup_digest(docs).orderBy("doc_id").collect()[1]
    assert row["n_removed"] == 300


def test_long_stretches_are_cut_so_that_each_window_is_in_one(spark, documents, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH_WORDS", 100)
    words = prose(45, 1000).split()
    docs = documents([(1, " ".join(words), "en")])
    anchors = substrings.sketches(docs, 50, 16).select("doc", "digest", F.col("anchors").alias("shared"))
    texts = docs.select(F.col("doc_id").alias("doc"), substrings.text_digest().alias("digest"), "text").join(anchors, ["doc", "digest"])
    stretches = sorted(substrings._stretches(texts, 50, 16).collect(), key=lambda row: row["start"])
    assert [(row["start"], len(row["words"].split(" "))) for row in stretches] == [(at, min(149, 1000 - at)) for at in range(0, 951, 100)]
    whole = substrings.anchored(words, 50, 16)[0].view("int64").tolist()
    assert [h for row in stretches for h in row["hashes"]] == whole


def test_windows_with_the_same_words_have_the_same_anchor():
    text = prose(1, 400).split()
    hashes, anchors = substrings.anchored(text, 50, 16)
    for start in (0, 13, 200):
        again, same = substrings.anchored([*prose(2, 30).split(), *text[start : start + 50], "x"], 50, 16)
        at = list(again).index(hashes[start])
        assert at == 30 and same[at] == anchors[start]


def test_an_empty_table(documents):
    assert substrings.dedup_digest(documents([])).collect() == []
    assert substrings.dedup(documents([])).collect() == []
