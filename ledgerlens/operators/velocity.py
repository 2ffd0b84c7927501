"""Rapid repeat transactions: a row and a later row of the same account within eleven minutes.

A gap counts while its complete minutes are at most ten, that is, while it is
above zero and below 660 seconds; the two transaction ids must differ. The
first row of a pair is called its leader, the second its follower.

Counting never builds pairs. Rows are first collapsed to one row per account
and instant; a running count inside eleven-minute cells then gives the followers
of each instant. A busy account spreads over its cells, and a cell holds no more
rows than the clock has instants, however many transactions share them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerlens.functions import exact
from ledgerlens.operators.arrow_groups import groups
from ledgerlens.operators.nearest_pairs import first_pairs
from ledgerlens.session import write_result, write_table

# Sent to Python workers by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MINUTE = 60_000_000
REACH = 11 * MINUTE  # first gap, in microseconds, that is too long
FILTER_WORDS = 2  # of 64 bits, in the Bloom filter of the ids at an instant


def _timed(rows: DataFrame) -> DataFrame:
    """Rows that can be part of a pair, with their instant in microseconds."""
    usable = rows.filter(F.col("account_key").isNotNull() & F.col("transaction_datetime").isNotNull())
    return usable.withColumn("instant", exact.epoch_micros(F.col("transaction_datetime")))


def _at_several_instants(rows: DataFrame, by: str) -> DataFrame:
    spans = rows.groupBy("account_key", by).agg(
        F.min("instant").alias("earliest"), F.max("instant").alias("latest")
    )
    return spans.filter(F.col("earliest") < F.col("latest")).select("account_key", by)


def _cell(instant: str = "instant") -> Column:
    return F.floor(F.col(instant) / F.lit(REACH)).cast("bigint")


def _adjacent_cells(rows: DataFrame) -> DataFrame:
    """Each row in its own cell, and once more in the cell before, where it can only follow."""
    return rows.withColumn("own_cell", _cell()).withColumn(
        "cell", F.explode(F.array(F.col("own_cell"), F.col("own_cell") - 1))
    )


def _id_bits() -> list[Column]:
    """A small Bloom filter of one id: a bit in each of some words."""
    id_hash = F.xxhash64("account_key", "transaction_id")
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftright(id_hash, 6 * i).bitwiseAND(63).cast("int")) for i in range(FILTER_WORDS)]


def _leaders(rows: DataFrame, same: list[str], leads: Column, watch_ids: bool = False) -> DataFrame:
    """Pairs per account, customer and instant of the leader, those with a leader amount, and what these add up to.

    A cell is as long as the reach. A leader is followed by whatever comes
    after it in its own cell, and in the next cell by whatever comes before the
    end of its reach; the first is counted where the leader stands, the second
    at a mark the leader sets in the next cell. With `watch_ids`, small Bloom filters of the ids
    go along, of an instant's leaders and of what follows; `own` tells that a leader may share its id with a follower.
    """
    units, cents = exact.value_sums(F.when(leads, F.col("row_cents")))
    words = range(FILTER_WORDS if watch_ids else 0)
    bits = _id_bits()
    instants = exact.with_cents(rows).groupBy(*same, "customer_key", "instant").agg(
        F.count(F.lit(1)).alias("rows_here"),
        F.count(F.when(leads, 1)).alias("leading_rows"),
        F.count(F.when(leads, F.col("row_cents"))).alias("leading_amounts"),
        exact.total_hundredths(units, cents).alias("leading_cents"),
        *[F.bit_or(bits[i]).alias(f"ids_{i}") for i in words],
        *[F.bit_or(F.when(leads, bits[i])).alias(f"leading_ids_{i}") for i in words],
    )
    stands = F.struct(
        _cell().alias("cell"), F.col("instant").alias("at"), F.col("rows_here").alias("counted"),
        *[F.col(f"ids_{i}").alias(f"seen_{i}") for i in words],
    )
    marks = F.struct(
        (_cell() + 1).alias("cell"),
        (F.col("instant") + (REACH - 1)).alias("at"),
        F.lit(0).cast("bigint").alias("counted"),
        *[F.lit(0).cast("bigint").alias(f"seen_{i}") for i in words],
    )
    places = instants.withColumn(
        "place", F.explode(F.when(F.col("leading_rows") > 0, F.array(stands, marks)).otherwise(F.array(stands)))
    ).select(
        *same, "customer_key", "instant", "leading_rows", "leading_amounts", "leading_cents", "place.*",
        *[f"leading_ids_{i}" for i in words],
    )
    in_cell = Window.partitionBy(*same, "cell")
    so_far = F.sum("counted").over(in_cell.orderBy("at"))
    whole_cell = F.sum("counted").over(in_cell)
    stands_here = F.col("at") == F.col("instant")
    after = in_cell.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    shared = F.lit(True) if watch_ids else F.lit(False)
    for i in words:
        seen = F.when(stands_here, F.bit_or(f"seen_{i}").over(after)).otherwise(F.bit_or(f"seen_{i}").over(in_cell.orderBy("at")))
        shared = shared & (F.col(f"leading_ids_{i}").bitwiseAND(F.coalesce(seen, F.lit(0))) != 0)
    return (
        places.withColumns({"followers": F.when(stands_here, whole_cell - so_far).otherwise(so_far), "own": shared})
        .filter((F.col("leading_rows") > 0) & (F.col("followers") > 0))
        .select(
            "account_key",
            "customer_key",
            "instant",
            (F.col("leading_rows") * F.col("followers")).alias("pairs"),
            (F.col("leading_amounts") * F.col("followers")).alias("paid_pairs"),
            (F.col("leading_cents") * F.col("followers")).cast(exact.WHOLE).alias("pair_cents"),
            *(["own"] if watch_ids else []),
        )
    )


def velocity_leaders(rows: DataFrame, leads: Column, unique_ids: bool = False, amounts: bool = True) -> DataFrame:
    """Pair count and, with `amounts`, pair-weighted leader amount by account, customer and instant of the leader.

    `rows` are the possible followers; those for which `leads` holds can lead.
    The counts of a leader may come in two rows, to be added up. Pairs of rows
    with one id are taken off: Bloom filters that go along with the counts tell which
    leaders can have such a pair, next to none where ids are unique, and only rows of the cells
    of these are looked at once more. With `unique_ids` the caller vouches that every row has an
    id and that an id never recurs at a second instant of its account.
    """
    timed = _timed(rows).select(
        "account_key", "customer_key", "transaction_id", "instant", "amount_usd", leads.alias("leads")
    )
    leads = F.col("leads")
    if unique_ids:
        return _leaders(timed, ["account_key"], leads)
    timed = timed.filter(F.col("transaction_id").isNotNull())
    key, counts = ["account_key", "customer_key", "instant"], ["pairs", "paid_pairs", "pair_cents"][: 3 if amounts else 1]
    # Only the columns that are wanted are written, so that no others are read.
    watched = _leaders(timed, ["account_key"], leads, watch_ids=True).select(*key, *counts, "own")
    watched = write_table(watched, "velocity-leaders")
    pairs = watched.drop("own")
    cells = watched.filter("own").select("account_key", F.explode(F.array(_cell(), _cell() + 1)).alias("cell"))
    cells = write_table(cells.distinct(), "suspect-cells")
    if cells.isEmpty():
        return pairs
    suspects = timed.withColumn("cell", _cell()).join(cells, ["account_key", "cell"], "left_semi").drop("cell")
    if not amounts:
        suspects = suspects.withColumn("amount_usd", F.lit(None).cast("decimal(18,2)"))
    suspects = write_table(suspects, "suspect-rows")
    recurring = _at_several_instants(suspects, "transaction_id")
    repeated = suspects.join(recurring, ["account_key", "transaction_id"], "left_semi")
    with_itself = _leaders(repeated, ["account_key", "transaction_id"], leads).select(*key, *counts)
    net = pairs.unionByName(with_itself.withColumns({name: -F.col(name) for name in counts}))
    sums = {name: F.sum(name) for name in counts}
    if amounts:
        sums["pair_cents"] = sums["pair_cents"].cast(exact.WHOLE)
    return net.groupBy(*key).agg(*[column.alias(name) for name, column in sums.items()]).filter(F.col("pairs") > 0)


_ROW = ["transaction_key", "transaction_id", "transaction_datetime", "instant", "amount_usd"]


def _as(rows: DataFrame, prefix: str, *more: str) -> DataFrame:
    return rows.select(*more, *[F.col(name).alias(f"{prefix}_{name}") for name in _ROW])


def _gap() -> Column:
    return F.col("second_instant") - F.col("first_instant")


def _real_pair() -> Column:
    return _gap().between(1, REACH - 1) & (F.col("first_transaction_id") != F.col("second_transaction_id"))


def velocity_pairs(leading: DataFrame, following: DataFrame) -> DataFrame:
    """Every pair of a leading and a following row: an equi-join on account and cell, each pair met once.

    The result is as large as the number of pairs; use `closest_pairs` for the
    top of the list.
    """
    first = _as(_timed(leading), "first", "account_key", "customer_key", "channel").withColumn(
        "cell", _cell("first_instant")
    )
    second = _as(_adjacent_cells(_timed(following)), "second", "account_key", "cell")
    return first.join(second, ["account_key", "cell"]).filter(_real_pair()).drop("cell")


def pair_order() -> list[Column]:
    """Nearest minute first, then the largest combined amount; the keys break ties."""
    return [
        F.floor(_gap() / F.lit(MINUTE)),
        (F.col("first_amount_usd") + F.col("second_amount_usd")).desc_nulls_last(),
        F.col("first_transaction_key"),
        F.col("second_transaction_key"),
    ]


def _candidates(rows: DataFrame, count: int) -> DataFrame:
    """The rows that can be in one of the first `count` pairs, a bounded number per account and instant.

    A pair shuns one id. So of the rows at one instant, `count` of each of the
    first `count` + 1 ids are enough: by amount, and by key for pairs whose
    combined amount is unknown. Leaders with and without a known customer, and
    rows with and without an amount, are chosen apart.
    """
    rows = rows.withColumn("unknown", F.col("amount_usd").isNull())
    here = ["account_key", "leads", "instant", "unknown"]

    def first(some: DataFrame, *order: Column) -> DataFrame:
        of_id = Window.partitionBy(*here, "transaction_id")
        ids = Window.partitionBy(*here).orderBy("best")
        return (
            some.withColumn("place", F.row_number().over(of_id.orderBy(*order)))
            .filter(F.col("place") <= count)
            .withColumn("best", F.min(F.struct(*order)).over(of_id))
            .withColumn("place", F.dense_rank().over(ids))
            .filter(F.col("place") <= count + 1)
            .drop("place", "best")
        )

    by_amount = first(rows, -F.col("amount_usd"), F.col("transaction_key"))
    by_key = first(rows.filter(~F.col("unknown")), F.col("transaction_key"))
    return by_amount.union(by_key).dropDuplicates([*here, "transaction_id", "transaction_key"])


def _next_instants(marked: DataFrame) -> DataFrame:
    """Instants of an account that a leader has and that another one follows within reach, with what their pairs can be.

    `minute` is that to the next instant, which none of the leader's pairs
    undercuts. `most` is what no pair of the leader exceeds in cents: its largest
    amount and the largest in its cell and the next. `real` tells that the
    largest amounts of both instants make a pair, as their ids differ for
    certain: it has `sum` cents, and `lead_key` for its first row. Rows are
    collapsed to instants before they are shuffled.
    """
    cents, id_hash = exact.hundredths(F.col("amount_usd")), F.xxhash64("transaction_id")
    instants = (
        marked.withColumns({"cents": cents, "id_hash": id_hash, "cell": _cell()})
        .groupBy("account_key", "cell", "instant")
        .agg(
            F.max(F.when(F.col("leads"), F.struct("cents", (-F.col("transaction_key")).alias("minus_key")))).alias("lead"),
            F.min(F.when(F.col("leads"), F.col("id_hash"))).alias("least_lead_id"),
            F.max(F.when(F.col("leads"), F.col("id_hash"))).alias("most_lead_id"),
            F.max("cents").alias("cents"),
            F.min("id_hash").alias("least_id"),
            F.max("id_hash").alias("most_id"),
        )
    )
    here = F.struct("cell", F.col("lead").isNotNull().alias("leads"))
    before = F.struct((F.col("cell") - 1).alias("cell"), F.lit(False).alias("leads"))  # there it can only follow
    placed = instants.withColumn("place", F.explode(F.array(here, before))).select(
        "account_key", "place.*", *(name for name in instants.columns if name not in ("account_key", "cell"))
    )
    cell = Window.partitionBy("account_key", "cell")
    after = cell.orderBy("instant")
    following = {f"next_{name}": F.lead(name).over(after) for name in ("instant", "cents", "least_id", "most_id")}
    apart = (F.col("most_lead_id") < F.col("next_least_id")) | (F.col("least_lead_id") > F.col("next_most_id"))
    return (
        placed.withColumns({**following, "largest": F.max("cents").over(cell)})
        .filter(F.col("leads") & (F.col("next_instant") - F.col("instant") < REACH))
        .select(
            "account_key",
            "cell",
            "instant",
            F.floor((F.col("next_instant") - F.col("instant")) / F.lit(MINUTE)).cast("int").alias("minute"),
            (F.col("lead.cents") + F.col("largest")).alias("most"),
            apart.alias("real"),
            (F.col("lead.cents") + F.col("next_cents")).alias("sum"),
            (-F.col("lead.minus_key")).alias("lead_key"),
        )
    )


def _can_be_among_first(leaders: DataFrame, count: int) -> tuple[DataFrame, int]:
    """The leaders that can have one of the first `count` pairs, and how many minutes such pairs are apart at most.

    Each leader's pair with the next instant is known without building others. The
    last of the first `count` of these is a bound for all: a leader whose
    next instant is a later minute, or the same minute while its largest
    possible sum is smaller, has no pair before it.
    """
    known = leaders.filter("real and lead_key is not null").orderBy("minute", F.col("sum").desc_nulls_last(), "lead_key").limit(count)
    found = known.select("minute", "sum", "lead_key").collect()
    if len(found) < count:
        return leaders, REACH // MINUTE - 1
    minute, least, key = max(
        ((row["minute"], row["sum"], row["lead_key"]) for row in found),
        key=lambda bound: (bound[0], bound[1] is None, -(bound[1] or 0), bound[2]),
    )
    reaches = F.lit(True)
    if least is not None:
        by_key = F.coalesce(F.col("lead_key") <= key, F.lit(True))
        reaches = F.coalesce((F.col("most") > least) | ((F.col("most") == least) & by_key), F.lit(False))
    return leaders.filter((F.col("minute") < minute) | ((F.col("minute") == minute) & reaches)), minute


def closest_pairs(rows: DataFrame, accounts: DataFrame, customers: DataFrame, count: int) -> DataFrame:
    """A small set of pairs among `rows` that holds the first `count` in `pair_order`.

    Only pairs whose account and leading customer are known count. A first
    pass over narrow columns finds each leader's next instant; a bound from `count`
    pairs that are known to exist then leaves few leaders, and only the cells of these
    are looked at with all columns. Their rows are cut to a bounded number
    per account and instant, and each account
    and cell gives its first `count` pairs, with rows of the next cell as
    followers only. A pair with an unknown amount comes after all others of
    its minute, by key alone.
    """
    timed = _timed(
        rows.select("account_key", "customer_key", "transaction_key", "transaction_id",
                    "transaction_datetime", "amount_usd", "channel").filter(F.col("transaction_id").isNotNull())
    )
    known = customers.select("customer_key", F.lit(True).alias("known"))
    of_accounts = timed.join(accounts.select("account_key"), "account_key", "left_semi")
    marked = of_accounts.join(known, "customer_key", "left").withColumn("leads", F.coalesce("known", F.lit(False)))
    minute = REACH // MINUTE - 1

    def first_leaders() -> DataFrame:
        nonlocal minute
        found, minute = _can_be_among_first(write_table(_next_instants(marked), "next-instants"), count)
        return found.select("account_key", "cell", "instant")

    kept = write_result(rows.sparkSession, first_leaders, "first-leaders")
    wanted = kept.select("account_key", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell")).distinct()
    near = timed.withColumn("cell", _cell()).join(wanted, ["account_key", "cell"], "left_semi").drop("cell")
    leading = kept.select("account_key", "instant", F.lit(True).alias("first"))
    chosen = (
        near.join(leading, ["account_key", "instant"], "left")
        .join(known, "customer_key", "left")
        .withColumn("leads", F.coalesce(F.col("first") & F.col("known"), F.lit(False)))
        .drop("first", "known")
    )
    cells = (
        _adjacent_cells(_candidates(chosen, count))
        .withColumn("leads", F.col("leads") & (F.col("cell") == F.col("own_cell")))
        .withColumn("cents", exact.hundredths(F.col("amount_usd")))
        .select("account_key", "cell", "leads", "cents", "customer_key", "channel", *_ROW)
        .repartition("account_key", "cell")
        .sortWithinPartitions("account_key", "cell", "instant")
    )

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "account_key", "cell"):
            ids = batch.column("transaction_id").dictionary_encode().indices.to_numpy()
            cents = batch.column("cents")
            side = {
                "time": batch.column("instant").to_numpy(),
                "value": cents.fill_null(0).to_numpy(),
                "key": batch.column("transaction_key").to_numpy(),
                "id": ids.astype(np.int64),
            }
            leads = batch.column("leads").to_numpy(zero_copy_only=False)
            unknown = cents.is_null().to_numpy(zero_copy_only=False)
            found: list[tuple[int, int]] = []
            everyone = np.ones(len(leads), bool)
            known = ~unknown
            for leaders, followers in ((known, known), (unknown, everyone), (known, unknown)):
                first, second = np.flatnonzero(leads & leaders), np.flatnonzero(followers)
                one, two = ({name: x[at] for name, x in side.items()} for at in (first, second))
                if followers is not leaders:  # the combined amount is unknown
                    one["value"], two["value"] = np.zeros_like(one["value"]), np.zeros_like(two["value"])
                pairs = first_pairs(one, two, count, MINUTE, minute + 1)
                found += [(int(first[a]), int(second[b])) for a, b in pairs]
            if found:
                one, two = (batch.take(pa.array(at, pa.int64())) for at in zip(*found, strict=True))
                columns = [one.column(name) for name in shared] + [side.column(name) for side in (one, two) for name in _ROW]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    shared = ("account_key", "customer_key", "channel")
    names = {f"{side}_{name}": cells.schema[name] for side in ("first", "second") for name in _ROW}
    schema = StructType(
        [cells.schema[name] for name in shared] + [StructField(name, f.dataType) for name, f in names.items()]
    )
    return cells.mapInArrow(nearest, schema)
