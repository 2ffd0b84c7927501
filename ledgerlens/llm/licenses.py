"""License detection by ordered signature rules."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.license_rules import CONFIDENCE, REACH, RULES, Rule
from ledgerlens.session import write_table

# All but digits, letters and whatever lies beyond ASCII, after A-Z were lower-cased.
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-cased (A-Z only) words of a text; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.filter(F.split(lower, _BETWEEN_WORDS), lambda word: word != "")


def detections(texts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every place where a rule matches: row, label, priority, base, first_word, end_word (exclusive).

    `texts` has row and places (array of position and the words from there),
    as made by `scan`. The few hundred rules are joined on their keyword, so
    an expression is tried only where its first word stands.
    """
    fields = [
        F.struct(
            F.lit(rule.keyword).alias("keyword"),
            F.lit(f"^(?:{rule.pattern})(?= |$)").alias("pattern"),
            F.lit(rule.label).alias("label"),
            F.lit(rule.priority).alias("priority"),
            F.lit(rule.base).alias("base"),
            F.lit(order).alias("order"),
        )
        for order, rule in enumerate(rules)
    ]
    table = F.broadcast(texts.sparkSession.range(1).select(F.inline(F.array(*fields))))
    places = texts.select("row", F.inline("places"))
    tried = places.join(table, F.substring_index("context", " ", 1) == F.col("keyword")).withColumn(
        "match", F.expr("regexp_extract(context, pattern, 0)")
    )
    return tried.filter("match != ''").select(
        "row",
        "label",
        "priority",
        "base",
        "order",
        F.col("position").cast("bigint").alias("first_word"),
        (F.col("position") + F.size(F.split("match", " "))).cast("bigint").alias("end_word"),
    )


def resolve(found: DataFrame) -> DataFrame:
    """The detections that stand: none lies within another of at least its priority.

    Of detections on the same words the higher priority stands, then the
    earlier rule. Detections that overlap without containment both stand.
    """
    by_start = (
        Window.partitionBy("row")
        .orderBy(F.col("first_word"), F.col("end_word").desc(), F.col("priority").desc(), F.col("order"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    contained = F.lit(False)
    for priority in CONFIDENCE:
        reach = F.max(F.when(F.col("priority") >= priority, F.col("end_word"))).over(by_start)
        within = (F.col("priority") == priority) & (reach >= F.col("end_word"))
        contained = contained | F.coalesce(within, F.lit(False))
    return found.withColumn("contained", contained).filter("not contained").drop("contained")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of `docs`: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One pass over the texts keeps, besides the key, only the words that
    follow a keyword; the rest works on that narrow table. Base rules report
    every place and always keep their labels; labels adds what stands of all
    rules. score is the confidence of the surest detection that stands, 0
    without one. A null or empty text has no words and no labels. Repeated
    rows and keys get rows of their own; an empty table gives an empty one.
    """
    keywords = sorted({rule.keyword for rule in rules})
    words = F.col("words")
    at = F.array_compact(F.transform(words, lambda word, i: F.when(word.isin(*keywords), i)))
    places = F.transform(
        at,
        lambda i: F.struct(
            i.alias("position"), F.array_join(F.slice(words, i + 1, F.lit(REACH)), " ").alias("context")
        ),
    )
    narrow = write_table(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.col(text)).alias("words")
        ).select("row", "key", F.size(words).cast("bigint").alias("n_words"), places.alias("places")),
        "license-places",
    )
    found = detections(narrow.filter(F.size("places") > 0), rules)
    base = (
        found.filter("base")
        .groupBy("row")
        .agg(
            F.count(F.lit(1)).alias("n_base"),
            F.min("first_word").alias("first_word"),
            F.max("first_word").alias("last_word"),
            F.collect_set("label").alias("base_set"),
        )
    )
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[F.col("priority")]
    standing = (
        resolve(found).groupBy("row").agg(F.collect_set("label").alias("set"), F.max(confidence).alias("score"))
    )
    none = F.array().cast("array<string>")
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return (
        narrow.drop("places")
        .join(base, "row", "left")
        .join(standing, "row", "left")
        .select(
            F.col("key").alias(key),
            "n_words",
            F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
            "first_word",
            "last_word",
            joined(F.coalesce("base_set", none)).alias("base_labels"),
            joined(F.array_union(F.coalesce("base_set", none), F.coalesce("set", none))).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
