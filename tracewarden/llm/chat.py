"""Chat formatting: collapse cumulative snapshots of conversations, then render what remains.

A conversation logged again after every turn appears as many conversations, each a prefix of the next.  A turn adds
to its conversation two hashes of its place, role and text; their running sums name every prefix.  A conversation
whose last prefix is a prefix of a longer one goes, by an anti-join; of equal conversations the one with the smallest
id stays.  Running sums are taken over slices of the whole order, so one conversation may hold any share of the rows;
it is rendered in parts of ``PART`` turns.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.scale import prefix_sums
from tracewarden.session import cut_lineage

PART = 64
_KEYS = ["no_id", "id"]
_BITS = (1 << 40) - 1


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return conversations.select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.xxhash64(text("role").isNull(), text("role"), text("text").isNull(), text("text")).alias("said"),
        text("role").alias("role"), text("text").alias("text"),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """``(no_id, id, turn, said, place, place_total, one, two)``: the name of the prefix that ends with each turn."""
    single = turns.groupBy(*_KEYS, "turn", "said").agg(F.lit(1).alias("n")).drop("n")
    placed = prefix_sums(single, _KEYS, ["turn", "said"], {"place": F.lit(1).cast("long")}, totals=True)
    named = {n: F.xxhash64(F.lit(k), "place", "said").bitwiseAND(F.lit(_BITS)) for k, n in enumerate(("one", "two"))}
    return cut_lineage(prefix_sums(placed, _KEYS, ["turn", "said"], named))


def render(conversations: DataFrame) -> DataFrame:
    """``(conv_id, part, n_turns, text)`` of the maximal conversations.

    Turns are in order of ``turn`` (nulls first), those of one turn number in order of a hash of role and text; a
    turn that is logged twice in a conversation counts once.  A null role or text is rendered as empty, but differs
    from an empty one in comparison; all rows without an id are one conversation.  ``n_turns`` counts the turns of
    the part.  Empty tables give no rows; extra columns are ignored.
    """
    turns = _turns(conversations)
    steps = prefixes(turns)
    name = ["place", "one", "two"]
    extended = steps.groupBy(*name).agg(F.max("place_total").alias("longest")).where("longest > place")
    whole = steps.where("place = place_total")
    least = F.min(F.struct(*_KEYS)).alias("least")  # an id before none
    kept = whole.groupBy(*name).agg(least).join(extended, name, "left_anti").select("least.no_id", "least.id")
    places = steps.select(*_KEYS, "turn", "said", "place").join(kept, _KEYS, "left_semi")
    spoken = turns.join(places, [*_KEYS, "turn", "said"])
    empty = F.lit("")
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", empty), F.lit("\n"), F.coalesce("text", empty), F.lit("<|im_end|>\n"))
    part = F.floor((F.col("place") - 1) / PART).alias("part")
    pieces = spoken.groupBy(*_KEYS, part).agg(F.array_sort(F.collect_set(F.struct("place", line.alias("line")))).alias("lines"))
    return pieces.select(
        F.when(F.col("no_id"), None).otherwise(F.col("id")).alias("conv_id"), "part",
        F.size("lines").cast("long").alias("n_turns"), F.array_join("lines.line", "").alias("text"),
    )
