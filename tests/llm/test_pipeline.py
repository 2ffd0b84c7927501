"""The pipeline: what each stage does to planted documents, and odd tables."""

from __future__ import annotations

import corpus_pipeline
import pytest
from texts import prose

ITEM = prose(70, 40) + ".\n" + prose(71, 8)
PASSAGE = prose(72, 80)
COPY = prose(73, 200)

ROWS = [
    (1, COPY, "en"), (2, COPY, "en"), (3, COPY + " more", "en"), (4, "123 456 !!", "en"), (5, None, "en"), (6, "", None),
    (7, prose(74, 100) + " " + PASSAGE, "en"), (8, PASSAGE + " " + prose(75, 100), "en"), (9, prose(76, 50) + " " + ITEM, "en"),
    (10, prose(77, 150), "en"), (11, prose(78, 60), None),
]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, documents, tmp_path):
    def write(rows):
        documents(rows).write.parquet(f"{tmp_path}/in/documents.parquet")
        spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
        return f"{tmp_path}/in"

    return write


def _stages(spark, folder, out):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        yield name, docs


def test_each_stage_takes_effect(spark, folder, tmp_path):
    after = {}
    for name, docs in _stages(spark, folder(ROWS), tmp_path):
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
    ids = {name: {r["doc_id"] for r in rows} for name, rows in after.items()}
    assert ids["language_id"] == {1, 2, 3, 7, 8, 9, 10, 11}
    assert ids["simhash_dedup"] >= {1, 7, 8, 9, 10, 11} and 2 not in ids["simhash_dedup"]
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after["substring_dedup"]}
    assert texts[7][0] == ROWS[6][1] and texts[8] == (prose(75, 100), len(prose(75, 100)))
    assert ids["decontamination"] == set(texts) - {9}
    assert ids["packing"] == ids["decontamination"]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES) - 1))
def test_columns_of_any_name_stay_as_they_are(spark, documents, folder, stage):
    """Names that the operators use themselves are kept with the user's values, and change nothing."""
    where = folder(ROWS)
    name, apply = corpus_pipeline.STAGES[stage]
    plain, extra = documents(ROWS), documents(ROWS, extra=True)
    kept = apply(spark, extra, where)
    assert kept.columns == extra.columns
    rows = kept.collect()
    own = [i for i, column in enumerate(kept.columns) if column not in COLUMNS]
    assert rows and all(row[i] == "x" for row in rows for i in own)
    assert sorted((row[:5] for row in map(tuple, rows)), key=str) == sorted(map(tuple, apply(spark, plain, where).collect()), key=str)


def test_run_gives_the_rows_of_the_last_stage(spark, folder, tmp_path):
    where = folder(ROWS)
    *_, (_, last) = _stages(spark, where, tmp_path)
    assert sorted(map(tuple, corpus_pipeline.run(spark, where).collect())) == sorted(map(tuple, last.collect()))


def test_an_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).collect() == []
