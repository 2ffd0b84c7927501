"""Exact substring dedup: suffix automata of repeated text, and documents streamed past them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.automaton import SuffixAutomaton
from ledgerlens.llm.rows import columns_of, whole_row
from ledgerlens.session import write_table

WINDOW = 50
GRAM = 16  # words of an anchor
SHARD_WORDS = 100_000  # words of an automaton
STREAM_WORDS = 2_000_000  # words that stream past one copy of an automaton
STRETCH_WORDS = 20_000  # windows of a stretch of a document; longer ones are cut, with an overlap
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LAST = (1 << 63) - 1  # stands for a missing doc_id

Batches = Iterator[pa.RecordBatch]


def words_of(text: str | None) -> list[str]:
    """What lies between ASCII blanks, unchanged."""
    return _WORD.findall(text or "")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of all runs of a text's words, by differences of prefix sums modulo 2^64."""

    def __init__(self, words: list[str]):
        numbers = np.fromiter((xxhash.xxh64_intdigest(word) for word in words), np.uint64, len(words))
        powers = np.full(len(words), _BASE)
        powers[:1] = 1
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers * np.cumprod(powers), dtype=np.uint64)))
        powers[1:] = _INVERSE
        self.back = np.cumprod(powers)

    def of(self, length: int) -> np.ndarray:
        sums = self.prefix[length:] - self.prefix[:-length]
        return _mixed(sums * self.back[: len(sums)])


def anchored(words: list[str], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and anchor of each window of a text, by its start.

    A window's anchor is the smallest hash of the grams in it, so equal
    windows have equal anchors, and neighbours mostly share one.
    """
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    hashes = _Hashes(words)
    grams = np.lib.stride_tricks.sliding_window_view(hashes.of(gram), window - gram + 1)
    return hashes.of(window), grams.min(axis=1)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row after another, lists as arrays, so that a batch is never held as Python objects."""
    names = batch.schema.names
    for place in range(batch.num_rows):
        row = {name: batch.column(name)[place] for name in names}
        yield {
            name: value.values.to_numpy() if pa.types.is_list(value.type) and pa.types.is_integer(value.type.value_type) else value.as_py()
            for name, value in row.items()
        }


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int64()))


def order_of(doc_id: Column | str) -> Column:
    """The place of a document among all: its doc_id, documents without one last."""
    return F.coalesce(F.col(doc_id).cast("bigint") if isinstance(doc_id, str) else doc_id, F.lit(_LAST))


def text_digest() -> Column:
    return F.xxhash64("text")


def _sha256(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def sketches(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per document: doc_id, doc (its order), digest, other_digest, n_words, sha256 of its words, anchors."""

    def sketch(batches: Batches) -> Batches:
        for batch in batches:
            sizes, sums, anchors = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                sizes.append(len(words))
                sums.append(_sha256(words))
                anchors.append(_signed(np.unique(anchored(words, window, gram)[1])))
            columns = [batch.column(c) for c in ("doc_id", "doc", "digest", "other_digest")]
            columns += [pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), _lists(anchors)]
            names = ["doc_id", "doc", "digest", "other_digest", "n_words", "sha256", "anchors"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, doc long, digest long, other_digest long, n_words long, sha256 string, anchors array<long>"
    return docs.select(
        F.col("doc_id").cast("bigint"),
        order_of("doc_id").alias("doc"),
        text_digest().alias("digest"),
        F.xxhash64(F.lit(1), "text").alias("other_digest"),
        "text",
    ).mapInArrow(sketch, schema)


def _stretches(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The stretches of each text (doc, digest, text, shared) whose windows are all under a shared anchor.

    (doc, digest, start, words, hashes), with the hashes of its windows by their starts. A long stretch is cut, with an overlap of a window less a word, so that each
    window is in one stretch. What is under no shared anchor stands in no other
    document, and goes no further.
    """

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for row in _rows(batch):
                words = words_of(row["text"])
                hashes, anchors = anchored(words, window, gram)
                starts = np.flatnonzero(np.isin(_signed(anchors), row["shared"]))
                parts = [
                    run[at : at + STRETCH_WORDS]
                    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
                    for at in range(0, len(run), STRETCH_WORDS)
                ]
                columns = [
                    pa.array([row["doc"]] * len(parts), pa.int64()),
                    pa.array([row["digest"]] * len(parts), pa.int64()),
                    pa.array([int(part[0]) for part in parts], pa.int64()),
                    pa.array([" ".join(words[part[0] : part[-1] + window]) for part in parts], pa.string()),
                    _lists([_signed(hashes[part]) for part in parts]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "digest", "start", "words", "hashes"])

    schema = "doc long, digest long, start long, words string, hashes array<long>"
    return texts.select("doc", "digest", "text", "shared").mapInArrow(cut, schema)


def _segments(owners: DataFrame, window: int) -> DataFrame:
    """The passages of each stretch that repeated windows cover: doc, stretch, first, words (blank-joined), n_words, hashes."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for row in _rows(batch):
                words, rows = row["words"].split(" "), []
                starts = np.flatnonzero(np.isin(row["hashes"], row["repeated"]))
                # Windows that overlap by all but a word go on in one passage.
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else []:
                    first, end = int(run[0]), int(run[-1]) + window
                    rows.append((first, " ".join(words[first:end]), end - first, np.unique(row["hashes"][run])))
                firsts, texts, sizes, hashes = list(zip(*rows, strict=True)) or [(), (), (), ()]
                columns = [
                    pa.array([row["doc"]] * len(rows), pa.int64()),
                    pa.array([row["stretch"]] * len(rows), pa.int64()),
                    pa.array(firsts, pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array(sizes, pa.int64()),
                    _lists(list(hashes)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "stretch", "first", "words", "n_words", "hashes"])

    schema = "doc long, stretch long, first long, words string, n_words long, hashes array<long>"
    return owners.select("doc", "stretch", "words", "hashes", "repeated").mapInArrow(cut, schema)


def _stream(mixed: DataFrame, window: int) -> DataFrame:
    """Removed spans (doc, digest, start, end) of stretches that follow the reference of their group.

    Rows come by group, the reference (without digest) first: it makes up an
    automaton, and then one stretch after another passes.
    """

    def match(batches: Batches) -> Batches:
        group, automaton, segments = None, None, []
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for row in _rows(batch):
                if row["group"] != group:
                    group, automaton, segments = row["group"], None, []
                if row["digest"] is None:
                    segments.append((row["doc"], row["words"].split(" ")))
                    continue
                if automaton is None:
                    automaton, segments = SuffixAutomaton(segments), []
                start = end = -1
                for place, owner in automaton.owners(row["words"].split(" "), window):
                    if owner < row["doc"]:
                        if place - window + 1 > end:
                            if end >= 0:
                                out.append((row["doc"], row["digest"], row["start"] + start, row["start"] + end))
                            start = place - window + 1
                        end = place + 1
                if end >= 0:
                    out.append((row["doc"], row["digest"], row["start"] + start, row["start"] + end))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            names = ["doc", "digest", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return mixed.mapInArrow(match, "doc long, digest long, start long, end long")


def removed_spans(docs: DataFrame, sketched: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Spans to remove (doc, digest, start, end), and the texts (doc, digest, text) of all documents.

    `sketched` is what `sketches` gives for `docs`, without copies. Copies of
    a text apart, text that repeats is found in four steps:
    anchors that several documents have; the stretches of documents under such anchors, and of their windows
    those that several documents have, whose hash tells the first one; the passages that
    such windows cover in their first document, which make up the reference;
    and the passing of stretches, each past the automata of those shards that
    have a window of it from an earlier document. Whole texts are moved once, and only where
    an anchor is shared; from there on stretches of bounded length are. Anchors and hashes only choose what is compared;
    what is removed is decided by the words in the automata.
    """
    key = ["doc", "digest"]
    anchors = sketched.select(*key, F.explode("anchors").alias("anchor"))
    common = (
        anchors.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    )
    shared = write_table(
        anchors.join(common.select("anchor"), "anchor").groupBy(*key).agg(F.collect_set("anchor").alias("shared")),
        "shared-anchors",
    )
    texts = docs.select(order_of("doc_id").alias("doc"), text_digest().alias("digest"), "text")
    suspects = texts.join(shared, key).dropDuplicates(key)
    stretches = write_table(
        _stretches(suspects, window, gram).withColumn("stretch", F.monotonically_increasing_id()),
        "stretches",
    )

    windows = stretches.select("doc", "stretch", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    holders = windows.groupBy("hash").agg(F.min("doc").alias("doc"), F.max("doc").alias("most"))
    owned = holders.filter("doc < most").groupBy("doc").agg(F.collect_list("hash").alias("repeated"))
    reference = write_table(_segments(stretches.join(owned, "doc"), window), "reference")
    total = reference.agg(F.sum("n_words")).first()[0] or 0
    shard = F.pmod(F.xxhash64("stretch", "first"), F.lit(total // SHARD_WORDS + 1))
    sharded = reference.withColumn("shard", shard)

    held = sharded.select("shard", F.col("doc").alias("owner"), F.explode("hashes").alias("hash"))
    visits = windows.join(held, "hash").filter("doc > owner")
    routes = write_table(visits.select("stretch", "size", "shard").distinct(), "routes")
    streams = routes.groupBy("shard").agg(F.ceil(F.sum(F.col("size") + (window - 1)) / STREAM_WORDS).cast("int").alias("streams"))
    passing = (
        routes.join(streams, "shard")
        .withColumn("stream", F.pmod(F.xxhash64("stretch"), F.col("streams")).cast("int"))
        .select("stretch", "shard", "stream")
        .join(stretches.select(*key, "stretch", "start", "words"), "stretch")
    )
    automata = sharded.join(streams, "shard").select(
        "doc",
        F.lit(None).cast("bigint").alias("digest"),
        F.lit(0).cast("bigint").alias("start"),
        "shard",
        F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"),
        "words",
    )
    mixed = (
        automata.unionByName(passing.drop("stretch"))
        .withColumn("group", F.concat_ws("/", "shard", "stream"))
        .repartition("group")
        .sortWithinPartitions("group", F.col("digest").isNotNull(), "doc")
        .select("group", "doc", "digest", "start", "words")
    )
    return write_table(_stream(mixed, window), "removed-spans"), texts


def _cut(texts: DataFrame, finish: Callable[[list[str], list[str]], tuple], schema: str) -> DataFrame:
    """Apply `finish` to the words and the kept words of each row (doc, digest, text, spans)."""

    def apply(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for row in _rows(batch):
                words = words_of(row["text"])
                keep = np.ones(len(words), bool)
                for span in row["spans"]:
                    keep[span["start"] : span["end"]] = False
                kept = [words[i] for i in np.flatnonzero(keep)]
                rows.append((row["doc"], row["digest"], *finish(words, kept)))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(names, row, strict=True)) for row in rows], schema=pa.schema(fields)
            )

    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))]
    names = [name for name, _ in fields]
    return texts.select("doc", "digest", "text", "spans").mapInArrow(apply, schema)


def _prepare(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows with `copied`, and the documents that lose words, with text and spans."""
    found = write_table(sketches(docs, window, gram), "sketches")
    same = ["digest", "other_digest"]
    # Stored, so that the joins below start from a shuffle of either side, which Spark can split at a hot text.
    firsts = write_table(found.groupBy(*same).agg(F.min("doc").alias("first")), "first-documents")
    marked = found.drop("anchors").join(firsts, same).withColumn("copied", F.col("doc") > F.col("first"))
    alone = found.join(firsts.withColumnRenamed("first", "doc"), [*same, "doc"], "left_semi")
    spans, texts = removed_spans(docs, alone.dropDuplicates(["doc", "digest"]), window, gram)
    by_document = spans.groupBy("doc", "digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return marked, texts.join(by_document, ["doc", "digest"]).dropDuplicates(["doc", "digest"])


def dedup_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256.

    Removed is each word within `window` consecutive words that also stand in
    a document with a smaller doc_id. Documents without a doc_id come last
    and take nothing from each other, as do rows with one doc_id. A null or
    empty text has no words. An empty table gives an empty one.
    """
    marked, cut = _prepare(docs, window, gram)
    counted = _cut(
        cut,
        lambda words, kept: (len(words) - len(kept), _sha256(kept)),
        "doc long, digest long, n_removed long, kept_sha256 string",
    )
    whole = F.col("copied") & (F.col("n_words") >= window)
    return marked.join(counted, ["doc", "digest"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`docs` without repeated text, all other columns as they are.

    What is removed is as in `dedup_digest`. A text that loses words becomes
    its kept words, joined by a blank, and a row that loses all words goes;
    other rows stay as they are. Further columns may have any names.
    """
    marked, cut = _prepare(docs, window, gram)
    shortened = _cut(cut, lambda words, kept: (" ".join(kept),), "doc long, digest long, kept string")
    gone = marked.filter(F.col("copied") & (F.col("n_words") >= window)).select("doc", "digest", F.lit("").alias("kept"))
    changes = write_table(shortened.unionByName(gone).distinct(), "changed-texts").select(
        F.col("doc").alias("at"), F.col("digest").alias("of"), "kept"
    )
    rows = docs.select(whole_row(docs), order_of("doc_id").alias("doc"), text_digest().alias("digest"))
    return (
        rows.join(changes, (F.col("doc") == F.col("at")) & (F.col("digest") == F.col("of")), "left")
        .filter("kept is null or kept <> ''")
        .select(*columns_of(docs, text=F.coalesce("kept", "row.text")))
    )
