"""Decontamination: the search against scoring everything, and documents that hold items or do not."""

from __future__ import annotations

import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest

from texts import prose

from ledgerlens.llm import bm25, decontamination
from ledgerlens.llm.bm25 import Index


def _index(draw, entries=150, vocabulary=80):
    cut = [[f"t{int(draw.random() ** 2 * vocabulary)}" for _ in range(draw.randrange(1, 30))] for _ in range(entries)]
    frequency = Counter(term for words in cut for term in set(words))
    return Index(cut, frequency, entries, sum(map(len, cut)) / entries), cut


def _scores(cut, query):
    """BM25 of each entry for a set of words, as a share of the entry's own total, by definition."""
    mean, found = sum(map(len, cut)) / len(cut), []
    for words in cut:
        weights = {}
        for term in set(words):
            n, df = words.count(term), sum(term in other for other in cut)
            idf = math.log(1 + (len(cut) - df + 0.5) / (df + 0.5))
            weights[term] = idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / mean))
        found.append(sum(weights.get(term, 0) for term in query) / sum(weights.values()))
    return found


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("most_parts", [1_000_000, 300])
def test_search_finds_what_scoring_everything_finds(seed, most_parts, monkeypatch):
    monkeypatch.setattr(bm25, "MOST_PARTS", most_parts)
    draw = random.Random(seed)
    index, cut = _index(draw, entries=draw.choice([1, 7, 8, 9, 120]))
    rows, expected = np.full((25, 60), -1, np.int32), {}
    threshold = draw.choice([0.05, 0.2, 0.6, 0.95])
    for number, row in enumerate(rows):
        words = [draw.choice(list(index.terms)) for _ in range(draw.randrange(0, 25))]
        if draw.random() < 0.5:
            words += draw.choice(cut)
        row[: len(words)] = [index.terms[word] for word in words]  # repeated words count once
        draw.shuffle(row)
        for entry, score in enumerate(_scores(cut, set(words))):
            if score >= threshold - 1e-9:
                expected[number, entry] = pytest.approx(score)
    query, entry, score = index.search(rows, threshold)
    assert len(query) == len(expected)
    assert dict(zip(zip(query.tolist(), entry.tolist(), strict=True), score.tolist(), strict=True)) == expected


def test_maxima_are_stored_per_block():
    index, _ = _index(random.Random(2))
    for part in range(len(index.part_first)):
        own = slice(index.part_first[part], index.part_first[part] + index.part_size[part])
        assert set(index.entry[own] // bm25.BLOCK) == {index.part_block[part]}
        assert index.part_most[part] == index.weight[own].max()


def test_blocks_that_cannot_reach_the_threshold_are_passed_over(monkeypatch):
    """Entries of other words are never scored."""
    cut = [[f"w{i}x{j}" for j in range(10)] for i in range(400)]
    index = Index(cut, Counter(t for e in cut for t in e), 400, 10)
    scored = []
    ranges = bm25._ranges
    monkeypatch.setattr(bm25, "_ranges", lambda first, size: scored.append(int(size.sum())) or ranges(first, size))
    query = np.array([[index.terms[word] for word in cut[7]] + [index.terms[cut[i][0]] for i in range(50, 400, 9)]], np.int32)
    assert index.search(query, 0.6)[1].tolist() == [7]
    assert scored == [49, 10]  # parts looked at, postings scored


def test_every_passage_is_a_query(monkeypatch):
    asked = []
    search = Index.search
    monkeypatch.setattr(Index, "search", lambda self, rows, threshold: asked.append(len(rows)) or search(self, rows, threshold))
    texts = [None, "", "one", prose(1, 64), prose(2, 65), prose(3, 200), prose(4, 100_000), prose(5, 129)]
    found = list(_shard(ITEMS).leaks(texts))
    passages = [max(math.ceil((len((text or "").split()) - 64) / 64), 1) for text in texts]
    assert len(found) == len(texts) and sum(asked) == sum(passages)
    assert max(asked) < 2 * decontamination.PASSAGES


def test_retrieval_decides_where_the_overlap_would_not():
    """All runs of five words of the item are there, each far from the others: no passage is about the item."""
    words = [f"q{i}" for i in range(30)]
    item = [(1, " ".join(words) + ".\n" + "a0 a1 a2 a3 a4 a5 a6")]
    runs = [words[i : i + 5] for i in range(26)] + [[f"a{j}" for j in range(i, i + 5)] for i in range(3)]
    scattered = " ".join(f"{' '.join(run)} {prose(i, 200)}" for i, run in enumerate(runs))
    shard = _shard(item + ITEMS)
    held = decontamination._Held(shard._numbers(scattered))
    assert shard.overlaps(held, 0) == (1.0, 1.0)
    together = f"{prose(70, 200)} {item[0][1]} {prose(71, 50)}"
    alone = scattered.replace("a0 a1 a2 a3 a4", "").replace("a1 a2 a3 a4 a5", "").replace("a2 a3 a4 a5 a6", "")
    assert [[leak[0] for leak in leaks] for leaks in shard.leaks([scattered.split("a0")[0], together, alone])] == [[], [1], []]


def test_an_index_is_held_in_arrays():
    """Some ten bytes for a character of the benchmark, with the words it consists of."""
    items = [(i, f"{prose(i, 60, 20_000)}.\n{prose(5000 + i, 9, 20_000)}") for i in range(2000)]
    size = len(pickle.dumps(_shard(items), protocol=5))
    assert size < 10 * sum(len(text) for _, text in items)


def test_long_texts_are_cut_between_words(monkeypatch):
    shard = _shard(ITEMS)
    text = " ".join(f"{t} x_{prose(i, 50)}" for i, t in ITEMS) + " ünïcode 东京 is_not"
    whole = shard._numbers(text).tolist()
    monkeypatch.setattr(decontamination, "LONG_TEXT", 40)
    monkeypatch.setattr(decontamination, "_STRETCH", re.compile(r"(?s).{1,40}(?:[^\W_]+|\Z|)"))
    assert shard._numbers(text).tolist() == whole


@pytest.mark.parametrize(
    ("text", "question", "answer"),
    [
        ("One two? Three.\nFour five.", ["one", "two", "three"], ["four", "five"]),
        ("One two? Three four.", ["one", "two"], ["three", "four"]),
        ("One two", ["one", "two"], []),
        ("One\n\n...\n", ["one"], []),
    ],
)
def test_question_and_answer(text, question, answer):
    assert decontamination.question_and_answer(text) == (question, answer)


def _shard(items):
    cut = [entry for _, text in items for entry in decontamination._entries(text)]
    frequency = Counter(term for entry in cut for term in set(entry))
    return decontamination.Shard.of(items, frequency, len(cut), sum(map(len, cut)) / len(cut))


ITEMS = [(i, prose(i, 12 + i * 9).replace(" ", "? ", 1) + ".\n" + prose(500 + i, 7)) for i in range(12)]
ODD_ITEMS = [(50, None), (51, ""), (52, "yes"), (None, prose(900, 20)), (7, ITEMS[7][1])]


def _documents():
    rows = []
    for i, text in ITEMS:
        rows.append((i, f"{prose(2000 + i, 300)}\n{text}\n{prose(3000 + i, 40)}", "en"))
        rows.append((100 + i, prose(4000 + i, 1 + i * 150), "en"))  # clean, with the items' words
        rows.append((200 + i, text.upper().replace(" ", " \n"), "en"))
        rows.append((300 + i, text.split("\n")[0], "en"))  # a question without its answer
    rows += [(400, None, None), (401, "", "en"), (None, ITEMS[3][1], "en"), (402, prose(5, 20_000) + " " + ITEMS[11][1], "en")]
    return rows


def _held():
    held = {(i, i) for i, _ in ITEMS} | {(200 + i, i) for i, _ in ITEMS} | {(None, 3), (402, 11)}
    return {pair: 2 if pair[1] == 7 else 1 for pair in held}  # item 7 is listed twice


@pytest.mark.parametrize("shard_chars", [16_000_000, 300])
def test_documents_that_hold_an_item(spark, documents, shard_chars):
    """In one index, and in many shards."""
    benchmark = spark.createDataFrame(ITEMS + ODD_ITEMS, "item_id long, text string")
    docs = documents(_documents(), extra=True)
    found = decontamination.find_leaks(docs, benchmark, shard_chars).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in found) == _held()
    assert all(r["score"] >= 0.6 and r["question_overlap"] >= 0.8 and r["answer_overlap"] >= 0.8 for r in found)
    kept = decontamination.drop_contaminated(docs, benchmark, shard_chars)
    assert kept.columns == docs.columns
    holders = {doc_id for doc_id, _ in _held()}
    left = {row for row in _documents() if row[0] not in holders}
    assert {(r["doc_id"], r["text"], r["lang"]) for r in kept.collect()} == left


def test_empty_tables(spark, documents):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents([(1, ITEMS[0][1], "en")])
    assert decontamination.find_leaks(documents([]), benchmark).collect() == []
    assert decontamination.find_leaks(docs, benchmark.limit(0)).collect() == []
    assert decontamination.drop_contaminated(docs, benchmark.limit(0)).count() == 1


SHORT_ITEMS = [(1, "What is the capital of France? Paris"), (2, "Yes."), (3, "东京是日本的首都吗？是"), (4, "ใครเป็นคนแรกที่เดินบนดวงจันทร์")]
SHORT_ITEMS += [(5, "水は何度で沸騰しますか。\n百度です"), (6, "首都？\n东京"), (7, " ... ")]


def test_short_items_and_scripts_without_blanks(spark, documents):
    """A short item counts where it stands word for word, and a clause without blanks is more than one word."""
    filler = "先日友人と山へ行きました天気は晴れでした"
    rows = [
        (1, f"{prose(1, 200)} what is the capital\nof France -- PARIS! {prose(2, 300)}", "en"),
        (2, f"The capital of France is what? Paris. {prose(3, 90)}", "en"),  # its words in another order
        (3, f"{prose(4, 700)} yes {prose(5, 9)}", "en"),
        (4, f"{filler}东京是日本的首都吗是{filler}", "zh"),
        (5, "อ่านต่อใครเป็นคนแรกที่เดินบนดวงจันทร์ครับ", "th"),
        (6, f"{filler}水は何度で沸騰しますか百度です{filler}", "ja"),
        (7, f"{filler}水は何度で{filler}沸騰しますか", "ja"),
        (8, "首都东京 yesterday", "zh"),
        (9, "东京首都", "zh"),
    ]
    benchmark = spark.createDataFrame(SHORT_ITEMS, "item_id long, text string")
    found = decontamination.find_leaks(documents(rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (3, 2), (4, 3), (5, 4), (6, 5), (8, 6)}
    assert all(r["question_overlap"] == 1 and r["answer_overlap"] == 1 for r in found)


@pytest.mark.parametrize("between", [0, 60, 300, 3000])
def test_question_and_answer_stand_apart(between):
    """Either part alone is retrieved, whatever stands between them, in either order, and both must be there."""
    items = [(i, f"{prose(100 + i, length)}.\n{prose(700 + i, answer)}") for i, (length, answer) in enumerate([(25, 20), (8, 1), (9, 90), (150, 30), (20, 23)])]
    shard = _shard(items)
    for i, text in items:
        question, answer = text.split("\n")
        other = prose(9000 + i, between)
        for parts in [(question, other, answer), (answer, other, question)]:
            [found] = shard.leaks(["\n".join([prose(i, 333), *parts, prose(50 + i, 70)])])
            assert [(item, shares) for item, _, *shares in found] == [(i, [1.0, 1.0])]
        assert list(shard.leaks([f"{other}\n{question}\n{other}", f"{other}\n{answer}\n{other}"])) == [[], []]
