"""Chat formatting: a state machine over roles and a template with loss flags."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, ANSWERED, WRONG = "first", "answered", "wrong"

# state -> role -> next state; a role that a state does not list is an error for good
TURN_ORDER: Mapping[str, Mapping[str, str]] = {
    FIRST: {"system": "primed", "user": "asked"},
    "primed": {"user": "asked"},
    "asked": {"assistant": ANSWERED},
    ANSWERED: {"user": "asked"},
}


@dataclass(frozen=True)
class Template:
    """A turn is written as: before, role, between, text, after.

    `escapes` are replaced one after another in roles and texts, and back in
    reverse order. The first protects the sign that all escapes start with
    and hold once; then none can arise by chance, and all come back. Every
    mark must hold a character that no escaped text holds.
    """

    before: str = "[INST]"
    between: str = "[/INST]"
    after: str = "</s>"
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
    trained_roles: tuple[str, ...] = ("assistant",)
    turn_order: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: TURN_ORDER)
    final_states: tuple[str, ...] = (ANSWERED,)

    def __post_init__(self) -> None:
        sign, written = self.escapes[0][0], [after for _, after in self.escapes]
        if any(not w.startswith(sign) or w.count(sign) > 1 for w in written):
            raise ValueError(f"escapes must start with {sign} and hold it once")
        if any(a != b and a.startswith(b) for a in written for b in written):
            raise ValueError("no escape may begin with another")
        if not all(any(plain in mark for plain, _ in self.escapes) for mark in (self.before, self.between, self.after)):
            raise ValueError("every mark must hold something that is escaped in texts")

    def escape(self, text: Column) -> Column:
        return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), self.escapes, text)

    def unescape(self, text: Column) -> Column:
        return reduce(lambda t, pair: F.replace(t, F.lit(pair[1]), F.lit(pair[0])), self.escapes[::-1], text)

    def end_state(self, turns: Column) -> Column:
        moves = [(f"{s}|{role}", then) for s, roles in self.turn_order.items() for role, then in roles.items()]
        table = F.create_map(*[F.lit(x) for move in moves for x in move])
        step = lambda state, turn: F.coalesce(
            F.try_element_at(table, F.concat(state, F.lit("|"), turn["role"])), F.lit(WRONG)
        )
        return F.aggregate(turns, F.lit(FIRST), step)

    def segments(self, turns: Column) -> Column:
        """The output's parts in order, each with its loss flag; only texts of trained roles have it."""

        def of_turn(turn: Column) -> Column:
            mark = F.concat(F.lit(self.before), self.escape(turn["role"]), F.lit(self.between))
            parts = (
                (mark, F.lit(False)),
                (self.escape(turn["text"]), turn["role"].isin(*self.trained_roles)),
                (F.lit(self.after), F.lit(False)),
            )
            return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

        return F.flatten(F.transform(turns, of_turn))

    def read_back(self, formatted: Column) -> Column:
        """The turns (role, text) of a formatted conversation."""
        pieces = F.split(formatted, rf"\Q{self.after}\E", -1)

        def turn(piece: Column) -> Column:
            halves = F.split(piece, rf"\Q{self.between}\E", -1)
            role = F.substring(halves[0], F.lit(len(self.before) + 1), F.length(halves[0]))
            return F.struct(self.unescape(role).alias("role"), self.unescape(halves[1]).alias("text"))

        return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted, valid.

    `turns` has conv_id, turn, role and text, in any order and with any
    further columns. Rows go by turn (null first), then role, then text, so
    repeated turns stay, in a defined order. A null role or text counts as
    empty, and rows without a conv_id make up one conversation. valid tells
    whether the state machine accepts the order of roles; conversations that
    it rejects are formatted all the same. An empty table gives an empty one.
    """
    template = template or Template()
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    cut = whole.select(
        "conv_id",
        template.segments(F.col("turns")).alias("segments"),
        template.end_state(F.col("turns")).isin(*template.final_states).alias("valid"),
    )
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def digest(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Hashes and lengths of formatted conversations, read back from the output alone."""
    template = template or Template()
    joined = lambda parts: F.array_join(parts, "")
    read = chats.select(
        "conv_id",
        "valid",
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        template.read_back(F.col("formatted")).alias("turns"),
        joined(
            F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
        ).alias("learned"),
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined(F.transform("turns", line)), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
