"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.components import components
from ledgerlens.llm.rows import columns_of, whole_row
from ledgerlens.session import write_table

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
# Buckets of up to so many fingerprints are compared pair by pair, larger ones through the fingerprints between.
PAIRED = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The bits that more than half of the shingles' hashes have; 0 without words.

    Words are what lies between ASCII blanks, with A-Z lower-cased. A shingle
    is `shingle` words joined by a blank, or all words if there are fewer;
    repeated shingles count each time.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    count = max(len(words) - shingle + 1, 1)
    starts = [0, *(ends[: count - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(count, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, print (the fingerprint as a signed number), digest (a hash of the text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            columns = [batch.column("doc_id"), pa.array(prints.view(np.int64)), batch.column("digest")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "digest"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", text_digest().alias("digest")).mapInArrow(
        compute, "doc_id long, print long, digest long"
    )


def text_digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any `radius` bits are all outside of one of them.

    Bit i gets a vector of radius+1 bits, not all 0; the mask of a vector v
    keeps the bits whose vector has an odd number of places in common with v.
    `radius` vectors span less than the whole space, so some v has an even
    number in common with each of them: in its table two fingerprints that
    differ in those bits meet.
    """
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        kept = [i for i in range(bits) if (i % vectors + 1 & v).bit_count() % 2]
        masks.append(sum(1 << i for i in kept))
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (left, right) that connect all of the distinct `print`s within `radius` bits of each other.

    Every table holds each fingerprint once, under the bits that its mask
    keeps. A bucket of few is compared pair by pair. In a bucket of many,
    each fingerprint is filed under all fingerprints that differ from it in
    half the radius of the bits outside the mask: two that share one differ
    in at most the radius, and two within the radius share one. All that
    share one are linked to the smallest of them, so the number of links
    follows the number of fingerprints, and there are no pairs at all.
    """
    if radius != 2:
        raise ValueError("the fingerprints between are laid out for a radius of 2 bits")
    masks = covering_masks(radius)
    value = F.col("print")
    keys = F.array(
        *[F.struct(F.lit(t).alias("table"), value.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]
    )
    filed = write_table(prints.select("print", F.inline(keys)), "covering-tables")
    # Stored, like the smallest ids below, so that Spark can split the join at a bucket or group of many.
    sizes = write_table(
        filed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "covering-sizes"
    )
    met = write_table(filed.join(sizes, ["table", "key"]), "covering-buckets")

    few = met.filter(F.col("size") <= PAIRED)
    one = few.select("table", "key", F.col("print").alias("left"))
    other = few.select(F.col("table").alias("_table"), F.col("key").alias("_key"), F.col("print").alias("right"))
    paired = one.join(
        other,
        F.expr(f"table = _table and key = _key and left < right and bit_count(left ^ right) <= {int(radius)}"),
    )

    many = met.filter(F.col("size") > PAIRED)
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    outside = reduce(
        lambda rest, t: F.when(F.col("table") == t, F.lit(_signed(~masks[t] & (1 << 64) - 1))).otherwise(rest),
        range(len(masks)),
        F.lit(0).cast("bigint"),
    )
    flip = F.explode(F.filter(flips, lambda flip: flip.bitwiseAND(outside) == flip))
    between = (
        many.select("print", flip.alias("flip"))
        .select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("middle"))
        .distinct()
    )
    hubs = between.groupBy("middle").agg(F.min("print").alias("left"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = between.join(hubs, "middle").filter("left <> print").select("left", F.col("print").alias("right"))
    return paired.select("left", "right").union(shared).distinct()


def group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: doc_id, print, digest, component (a number of the group), component_id.

    component_id is the smallest doc_id of the group. Documents with one
    fingerprint, those without words or text (0) included, are one group, and
    so are those whose fingerprints are linked. Rows without a doc_id take
    part; a group of such rows alone has no component_id. Only distinct
    fingerprints are compared, so copies cost nothing. An empty table gives
    an empty one.
    """
    found = write_table(fingerprints(docs, shingle), "fingerprints")
    classes = write_table(found.groupBy("print").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    reached = components(links(classes.select("print"), radius))
    placed = classes.join(reached, classes["print"] == reached["node"], "left").select(
        "print", "first", F.coalesce("component", "print").alias("component")
    )
    ids = write_table(placed.groupBy("component").agg(F.min("first").alias("component_id")), "smallest-ids")
    named = placed.join(ids, "component").select("print", "component", "component_id")
    return found.join(named, "print")


def hexadecimal(value: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each group, all columns as they are.

    The row with the smallest doc_id stays (any id before none, then by hash
    of the text). Rows are found again by doc_id and hash of the text; where
    the row that stays is repeated, one of its copies does.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    counted = group(docs, shingle, radius).groupBy("component", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    first = counted.groupBy("component").agg(F.min(F.struct(place.alias("place"), "copies")).alias("first"))
    winners = write_table(
        first.select(
            F.col("first.place.doc_id").alias("id"), F.col("first.place.digest").alias("of"), "first.copies"
        ),
        "kept-documents",
    )
    marked = docs.select(whole_row(docs), "doc_id", text_digest().alias("digest"))

    def rows(chosen: DataFrame) -> DataFrame:
        same = marked["doc_id"].eqNullSafe(chosen["id"]) & (marked["digest"] == chosen["of"])
        return marked.join(chosen, same, "left_semi")

    single, repeated = rows(winners.filter("copies = 1")), rows(winners.filter("copies > 1"))
    return single.union(repeated.dropDuplicates(["doc_id", "digest"])).select(*columns_of(docs))
