"""Near duplicates among embeddings: iterative quantisation, multi-index Hamming tables, exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ledgerlens.llm.components import components
from ledgerlens.operators.arrow_groups import groups
from ledgerlens.session import write_table

THRESHOLD = 0.93
SAMPLE_VALUES = 500_000  # numbers in the sample that the rotations are learned on, at most
ITERATIONS = 30
RECALL = 0.995  # expected share of pairs just at the threshold that meet in a table
TURNED = 4000  # pairs at the threshold, made of the sample, on which the recall of learned codes is measured
BLOCK = 1024  # members of a bucket that one task compares with as many others
PAIRS = 100_000  # links of a bucket that are looked up in earlier tables at once


class Rotations:
    """Binary codes of one dimension's vectors, cut into one key per table.

    Each rotation is learned by iterative quantisation: principal directions
    of the centred sample are turned until the signs lose the least. A code
    has as many bits as the vector has numbers (at most 64); several codes
    from different starts follow one another until there are enough keys.
    """

    def __init__(self, sample: np.ndarray, key_bits: int, tables: int):
        self.key_bits, self.tables = key_bits, tables
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, directions = np.linalg.eigh(centred.T @ centred)
        bits = min(64, sample.shape[1])
        principal = directions[:, ::-1][:, :bits]
        projected = centred @ principal
        random = np.random.default_rng(11)
        turns = []
        for _ in range(max(-(-key_bits * tables // bits), 1)):
            turn, _ = np.linalg.qr(random.standard_normal((bits, bits)))
            for _ in range(ITERATIONS):
                left, _, right = np.linalg.svd(np.sign(projected @ turn).T @ projected)
                turn = (left @ right).T
            turns.append(principal @ turn)
        # Bits of all codes are dealt out at random, so that no table gets the weak directions only.
        order = random.permutation(bits * len(turns))[: key_bits * tables]
        self.projection = np.concatenate(turns, axis=1)[:, order]

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.projection > 0

    def keys(self, unit: np.ndarray) -> np.ndarray:
        return keys_of(self.bits(unit), self.tables, self.key_bits)


def keys_of(bits: np.ndarray, tables: int, key_bits: int) -> np.ndarray:
    """The keys, one for each table, that codes are made of."""
    return bits.reshape(len(bits), tables, key_bits) @ (1 << np.arange(key_bits, dtype=np.int64))


def table_sizes(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for the number of vectors under one label.

    Keys have four bits more than it takes to number the vectors, so buckets
    of unlike vectors stay small at any size. Signs of two vectors at an
    angle differ with the probability angle / pi, and the tables are as many
    as it takes for two vectors at the threshold to meet with probability `recall`.
    """
    key_bits = min(max(math.ceil(math.log2(max(vectors, 2))) + 4, 8), 40)
    meet = (1 - math.acos(threshold) / math.pi) ** key_bits
    return key_bits, math.ceil(math.log(1 - recall) / math.log1p(-meet))


def _turned(sample: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold: vectors of the sample, and the same turned by its angle.

    Half of them are turned in any direction, half towards where vectors of
    the sample differ, which are the directions that codes are made of.
    """
    random = np.random.default_rng(12)
    one, other, third = (sample[random.integers(len(sample), size=TURNED)] for _ in range(3))
    towards = random.standard_normal(one.shape)
    towards[::2] = np.where((other != third).any(axis=1, keepdims=True), other - third, towards)[::2]
    towards -= (towards * one).sum(axis=1, keepdims=True) * one
    length = np.linalg.norm(towards, axis=1, keepdims=True)
    towards = np.where(length > 1e-9, towards / np.maximum(length, 1e-9), 0)  # one dimension has no other direction
    return one, _unit(threshold * one + math.sqrt(max(1 - threshold**2, 0.0)) * towards)


def _tables_for(differ: np.ndarray, key_bits: int, most: int, recall: float) -> int | None:
    """How many tables give the recall, at most `most`, for pairs of which such shares of the bits differ."""
    apart = np.log1p(-np.minimum((1 - differ) ** key_bits, 1 - 1e-15))

    def enough(tables: int) -> bool:
        return 1 - np.exp(apart * tables).mean() >= recall

    if not enough(most):
        return None
    low, high = 0, most  # the answer is above low
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def learn(sample: np.ndarray, vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Rotations:
    """Codes for unit vectors like those of the sample, up to `vectors` under one label.

    `table_sizes` goes by the angle at the origin. Codes are signs after the
    mean is subtracted, and vectors that share a large mean lie at wider
    angles around it. So the recall is measured on turned vectors: tables are
    added up to twice as many, then bits are taken away, down to a single
    bucket, until the recall is there.
    """
    key_bits, least = table_sizes(vectors, threshold, recall)
    most, tables = 2 * least, least
    one, other = _turned(sample, threshold)
    while True:
        rotations = Rotations(sample, key_bits, tables)
        if (rotations.keys(one) == rotations.keys(other)).any(axis=1).mean() >= recall:
            return rotations
        differ = (rotations.bits(one) != rotations.bits(other)).mean(axis=1)
        wanted = max(_tables_for(differ, key_bits, most, recall) or most + 1, tables + max(tables // 16, 1))
        while wanted > most:
            key_bits -= 1
            wanted = _tables_for(differ, key_bits, most, recall) or most + 1
        tables = wanted


def _unit(values: np.ndarray) -> np.ndarray:
    values = _moderate(values)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _moderate(values: np.ndarray) -> np.ndarray:
    """The same directions, with numbers whose squares neither overflow nor vanish; others stay as they are."""
    largest = np.abs(values).max(axis=1, initial=0, keepdims=True)
    far = (largest > 1e100) | (largest < 1e-100)
    return values / np.where(far, largest, 1.0) if far.any() else values


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _encode(classes: DataFrame, models: dict[int, Rotations]) -> DataFrame:
    """`classes` with the keys to file them under, and the code they are made of, eight bits to a byte."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part, model = batch.filter(pa.array(sizes == size)), models[int(size)]
                bits = model.bits(_unit(_matrix(part.column("vector"), int(size))))
                keys = pa.array(list(keys_of(bits, model.tables, model.key_bits)), pa.list_(pa.int64()))
                codes = pa.array([code.tobytes() for code in np.packbits(bits, axis=1)], pa.binary())
                shape = [pa.array(np.full(len(bits), number, np.int32)) for number in (model.tables, model.key_bits)]
                columns = [*part.columns, *shape, keys, codes]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "tables", "key_bits", "keys", "code"])

    kind = classes.schema["vector"].dataType.simpleString()
    schema = f"class long, label long, size int, n long, vector {kind}, tables int, key_bits int, keys array<long>, code binary"
    return classes.select("class", "label", "size", "n", "vector").mapInArrow(encode, schema)


def _unpacked(codes: pa.Array, tables: int, key_bits: int) -> np.ndarray:
    """The keys of packed codes."""
    packed = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -(-tables * key_bits // 8))
    return keys_of(np.unpackbits(packed, axis=1, count=tables * key_bits), tables, key_bits)


def _compare(classes: np.ndarray, weights: np.ndarray, values: np.ndarray, keys: np.ndarray, table: int, block: np.ndarray,
             crossed: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links that each class has in one bucket and no earlier table, weighted, and links that span the bucket's groups."""
    values = _moderate(values)
    norms = np.linalg.norm(values, axis=1)
    near = values @ values.T / norms[:, None] / norms >= threshold
    np.fill_diagonal(near, False)
    if crossed:
        near &= block[:, None] != block
    counts = np.zeros(len(classes), np.int64)
    one, other = np.nonzero(near)
    for some in range(0, len(one), PAIRS):  # which of the pairs have met before is asked of links alone
        left, right = one[some : some + PAIRS], other[some : some + PAIRS]
        fresh = ~(keys[left, :table] == keys[right, :table]).any(axis=1)
        np.add.at(counts, left[fresh], weights[right[fresh]])
    spanning: list[tuple[int, int]] = []
    unseen = np.ones(len(classes), bool)
    for start in np.flatnonzero(near.any(axis=1)):
        if unseen[start]:
            unseen[start] = False
            waiting = [start]
            while waiting:
                node = waiting.pop()
                found = np.flatnonzero(near[node] & unseen)
                unseen[found] = False
                spanning += [(int(classes[node]), int(classes[other])) for other in found]
                waiting += found.tolist()
    return counts, spanning


def _links(buckets: DataFrame, threshold: float) -> DataFrame:
    """Rows (left, right, n): with right, a link; without, how many vectors left is linked to in one bucket."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for bucket in groups(batches, "group"):
            table, crossed = bucket.column("table")[0].as_py(), bucket.column("crossed")[0].as_py()
            classes = bucket.column("class").to_numpy()
            counts, spanning = _compare(
                classes,
                bucket.column("n").to_numpy(),
                _matrix(bucket.column("vector"), bucket.column("size")[0].as_py()),
                _unpacked(bucket.column("code"), bucket.column("tables")[0].as_py(), bucket.column("key_bits")[0].as_py()),
                table,
                bucket.column("block").to_numpy(),
                crossed,
                threshold,
            )
            some = np.flatnonzero(counts)
            out += [(int(classes[i]), None, int(counts[i])) for i in some]
            out += [(a, b, 0) for a, b in spanning]
            if len(out) > 50_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return buckets.mapInArrow(compare, "left long, right long, n long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["left", "right", "n"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    `vectors` has vec_id, embedding and label. Rows with one label and one
    number of components link at a cosine, in double precision, of at least
    `threshold`. Rows without a label, and vectors that are null, empty, zero
    or hold a null or a non-finite number, link with nothing. Equal vectors
    are one class and cost no comparison. Classes that share a key in some
    table are compared with their original vectors, each pair counted in the
    first table where it meets; a large bucket is cut into blocks that many
    tasks compare. component_id is the smallest vec_id of the component, the
    row's own vec_id without links. An empty table gives an empty one.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    # Numbers keep their precision; whole numbers and decimals become doubles.
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    hashed = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"),
        F.coalesce(usable, F.lit(False)).alias("usable"),
        F.xxhash64("embedding").alias("hash"),
        F.xxhash64(F.lit(1), "embedding").alias("other_hash"),
    )
    same = ["label", "hash", "other_hash"]
    classes = write_table(
        hashed.filter("usable")
        .groupBy(*same)
        .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.first("vector").alias("vector"))
        .withColumn("size", F.size("vector"))
        .withColumn("class", F.monotonically_increasing_id()),
        "vector-classes",
    )
    label_sizes = classes.groupBy("size", "label").agg(F.count(F.lit(1)).alias("n"))
    models: dict[int, Rotations] = {}
    for row in label_sizes.groupBy("size").agg(F.max("n").alias("n")).collect():
        wanted = max(SAMPLE_VALUES // row["size"], 2)
        some = classes.filter(F.col("size") == row["size"]).orderBy("hash", "class").limit(wanted).select("vector")
        sample = _matrix(some.toArrow().column("vector").combine_chunks(), row["size"])
        models[row["size"]] = learn(_unit(sample), row["n"], threshold)

    encoded = write_table(_encode(classes, models), "vector-codes")
    filed = encoded.select("class", "label", "size", F.posexplode("keys").alias("table", "key"))
    place = ["label", "size", "table", "key"]
    # Stored, like the smallest ids below, so that Spark can split the join at a bucket or component of many.
    shared = write_table(
        filed.groupBy(*place).agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared-buckets"
    )
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    met = (
        filed.join(shared, place)
        .withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
        .withColumn("other", other)
        .withColumn("group", F.xxhash64(*place, F.least("block", "other"), F.greatest("block", "other")))
        .select("class", "table", "block", "group", (F.col("block") != F.col("other")).alias("own"))
    )
    # A block meets itself in a group of its own; groups of two blocks count only what crosses.
    buckets = (
        met.withColumnRenamed("own", "crossed")
        .join(encoded.select("class", "size", "n", "vector", "tables", "key_bits", "code"), "class")
        .repartition("group")
        .sortWithinPartitions("group")
        .select("group", "table", "crossed", "block", "class", "size", "n", "vector", "tables", "key_bits", "code")
    )
    compared = write_table(_links(buckets, threshold), "vector-links")
    counts = compared.filter("right is null").groupBy("left").agg(F.sum("n").alias("linked"))
    reached = components(compared.filter("right is not null"))
    placed = (
        classes.join(counts, classes["class"] == counts["left"], "left")
        .join(reached, classes["class"] == reached["node"], "left")
        .select(*same, "n", "first", "linked", F.coalesce("component", "class").alias("component"))
    )
    ids = write_table(placed.groupBy("component").agg(F.min("first").alias("component_id")), "smallest-ids")
    known = placed.join(ids, "component").select(
        *same, (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("usable")
    )
    return (
        hashed.drop("vector")
        .join(known, [*same, "usable"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
