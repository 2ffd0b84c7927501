from __future__ import annotations

import pytest

# Columns that the operators use inside, here as further columns of the input.
CLASHING = ["row", "key", "digest", "component", "class", "group", "shard", "n_words", "score", "length", "size", "label"]
CLASHING += ["_kept", "_digest", "_doc", "_at", "_text_digest", "_row_digest", "_language", "_id", "_copies", "_number", "_run", "_spread"]
CLASHING += ["doc", "at", "of", "kept", "id", "copies", "language", "found", "spans", "leaks", "text_crc32", "held_out", "other_digest"]
CLASHING += ["a.b", "with `ticks`", "print", "place", "first", "n_bytes", "n_tokens", "number", "seam", "chunks"]


@pytest.fixture
def documents(spark):
    """Build a documents table; `extra` adds columns whose names the operators use themselves."""

    def build(rows: list[tuple], extra: bool = False):
        frame = spark.createDataFrame(
            [(i, text, lang, "src", len(text) if text is not None else None) for i, text, lang in rows],
            "doc_id long, text string, lang string, source string, n_chars long",
        )
        return frame.selectExpr("*", *[f"'x' as `{name.replace('`', '``')}`" for name in CLASHING if extra])

    return build
