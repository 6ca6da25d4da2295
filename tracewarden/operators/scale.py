"""Order-dependent building blocks that never put one key, or one global order, into one task.

* ``ordered_slices``   contiguous, row-balanced runs of a total order
* ``prefix_sums``      running sums over a total order
* ``trailing_rows``    ROWS frames (last *n* rows)
* ``trailing_counts``  RANGE frames (rows in the last *w* microseconds)
* ``exact_quantiles``  linear-interpolated quantiles from value counts

A plain ``Window`` gives one task per partition key, so a key holding a third of the rows stalls
the job and a frame without a key runs on a single task.  Here the order is cut into slices by
range partitioning on the *whole* order (keys plus a unique tie-break), so a hot key simply spans
many slices; what crosses a slice border is one summary row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import cut_lineage


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Range-partition on ``keys + order``, sort inside each slice and number the slices.

    The checkpoint makes the slice numbers data: both the summaries and the rows read the same
    assignment, whatever is recomputed later.  ``order`` must end in a unique column, otherwise
    duplicates of one full order value share a slice.  Without ``slices`` Spark sizes them: it starts
    from ``spark.sql.shuffle.partitions`` ranges and merges neighbours that turn out small, which keeps
    every slice a contiguous run.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    return cut_lineage(ranged.sortWithinPartitions(*by).withColumn("slice_id", F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    slices: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Append the inclusive running sum of every expression in ``sums`` per ``keys`` along ``order``.

    A null key is a key of its own.  Running sums are local to a slice; the offset of a slice is the total
    of the earlier slices of the same key, which exists only for the first key of a slice, so the
    joined offset table has at most one row per slice.  ``totals`` also appends ``{name}_total``, the
    sum over the whole key, from the same per-slice summaries (one row per slice and key).
    """
    names = list(sums)
    staged = df.select("*", *[sums[n].alias(f"_in_{n}") for n in names])
    cut = ordered_slices(staged, keys, order, slices)
    # one row per slice and key; the window below holds at most one row per slice in a partition
    per_slice = cut.groupBy("slice_id", *keys).agg(*[F.sum(f"_in_{n}").alias(n) for n in names])
    of_key = Window.partitionBy(*(list(keys) or [F.lit(0)]))
    earlier = of_key.orderBy("slice_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        "slice_id",
        *keys,
        *[F.sum(n).over(earlier).alias(f"_off_{n}") for n in names],
        *[F.sum(n).over(of_key).alias(f"{n}_total") for n in names if totals],
    )
    if not totals:
        offsets = offsets.filter(F.col(f"_off_{names[0]}").isNotNull())
    local = Window.partitionBy("slice_id", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = offsets.withColumnsRenamed({"slice_id": "_slice"} | {k: f"_key{i}" for i, k in enumerate(keys)})
    same = F.col("slice_id") == F.col("_slice")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return cut.join(at, same, "left").select(
        *df.columns,
        *[(F.sum(f"_in_{n}").over(local) + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n) for n in names],
        *[f"{n}_total" for n in names if totals],
    )


def trailing_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    sums: Mapping[str, Column],
    slices: int | None = None,
    lists: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Append sums (and ordered lists) over the last ``n`` rows, this one included, ``frame_rows`` and ``position``.

    Positions come from ``prefix_sums``; rows are then grouped into blocks of consecutive positions,
    each extended by the ``n - 1`` rows before it, so a frame never needs more than its block.
    """
    names, listed = list(sums), list(lists or {})
    block = max(4096, 8 * n)
    measured = df.select(
        "*", *[sums[m].alias(f"_m_{m}") for m in names], *[lists[m].alias(f"_l_{m}") for m in listed]
    )
    placed = prefix_sums(measured, keys, order, {"position": F.lit(1)}, slices)
    home = F.floor((F.col("position") - 1) / block)
    reaches_next = (F.col("position") - 1) % block >= block - (n - 1)
    copies = placed.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(reaches_next, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("position").rowsBetween(-(n - 1), 0)
    return (
        copies.select(
            *df.columns,
            "position",
            "_home",
            "_block",
            F.count(F.lit(1)).over(frame).alias("frame_rows"),
            *[F.sum(f"_m_{m}").over(frame).alias(m) for m in names],
            *[F.collect_list(f"_l_{m}").over(frame).alias(m) for m in listed],
        )
        .filter(F.col("_home") == F.col("_block"))
        .drop("_home", "_block")
    )


def trailing_counts(
    df: DataFrame,
    key: str,
    us: str,
    windows: Mapping[int, float | None],
    *,
    inclusive: bool = True,
    cell_us: int | None = None,
) -> DataFrame:
    """Rows of the same key within the trailing window, per distinct ``(key, us)`` moment.

    ``windows`` maps a width in microseconds to a floor: only counts strictly above it are wanted
    (``None`` keeps all).  Result: ``key, us, n (rows at the moment), width_us, frame_count``.
    ``inclusive`` says whether a row exactly ``width`` old still counts.

    The time line is cut into cells.  First the per-cell totals (map-side combined, one row per key
    and cell) bound every frame from above; keys whose bound never passes a floor are dropped before
    any event is shuffled.  For the rest a frame is the difference of two running counts over slices of equal
    volume, so a burst is split however many rows it has, whatever the width of the window.
    """
    cell = cell_us or max(1, min(windows) // 4)
    cell_of = lambda c: F.floor(c / F.lit(cell))
    base = df.select(F.col(key).alias("_k"), F.col(us).cast("long").alias("_t"))

    floors = [f for f in windows.values()]
    if all(f is not None for f in floors):
        cells = base.groupBy("_k", cell_of(F.col("_t")).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
        over = Window.partitionBy("_k").orderBy("_c")
        bounds = [
            F.sum("_n").over(over.rangeBetween(-(-(-width // cell)), 0)) > F.lit(floor)
            for width, floor in windows.items()
        ]
        hot = F.lit(False)
        for b in bounds:
            hot = hot | b
        keep = cells.select("_k", hot.alias("_hot")).filter("_hot").select("_k").distinct()
        base = base.join(keep, "_k", "left_semi")

    moments = base.groupBy("_k", "_t").agg(F.count(F.lit(1)).alias("n"))
    # markers: 0 sorts before the arrivals (1) of the same instant, 2 after them
    side = 0 if inclusive else 2
    marks = F.array(
        F.struct(F.col("_t").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("width"), F.col("n").alias("add")),
        *[
            F.struct(
                (F.col("_t") - F.lit(w)).alias("at"),
                F.lit(side).alias("kind"),
                F.lit(w).cast("long").alias("width"),
                F.lit(0).cast("long").alias("add"),
            )
            for w in windows
        ],
    )
    records = moments.select("_k", "_t", "n", F.explode(marks).alias("m")).select(
        "_k", "_t", "n", F.col("m.at").alias("at"), F.col("m.kind").alias("kind"), F.col("m.width").alias("width"), F.col("m.add").alias("add")
    )
    running = prefix_sums(records, ["_k"], ["at", "kind", "width"], {"run": F.col("add")})
    per_moment = running.groupBy("_k", "_t").agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("width") == 0, F.col("run"))).alias("_upto"),
        *[F.max(F.when(F.col("width") == w, F.col("run"))).alias(f"_w{w}") for w in windows],
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(w).cast("long").alias("width_us"), F.col(f"_w{w}").alias("lead")) for w in windows])
    ).alias("p")
    out = per_moment.select("_k", "_t", "n", "_upto", rows).select(
        F.col("_k").alias(key),
        F.col("_t").alias(us),
        "n",
        F.col("p.width_us").alias("width_us"),
        (F.col("_upto") - F.col("p.lead")).alias("frame_count"),
    )
    wanted = F.lit(False)
    for width, floor in windows.items():
        hit = F.col("width_us") == F.lit(width)
        wanted = wanted | (hit if floor is None else hit & (F.col("frame_count") > F.lit(floor)))
    return out.filter(wanted)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], slices: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles: rows ``keys, prob, quantile``; null values are ignored.

    Value counts are combined before the shuffle and ranked with ``prefix_sums``; no task ever holds
    the distinct values of a whole group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix_sums(counts, keys, [value], {"_cum": F.col("_n")}, slices, totals=True)
    return ranked_quantiles(ranked, keys, value, probs, "_n", "_cum", "_cum_total")


def ranked_quantiles(ranked: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], n: str, cum: str, total: str) -> DataFrame:
    """``exact_quantiles`` from value counts that already have their running sums and totals."""
    spot = lambda p: p * (F.col(total) - 1)
    first, last = F.col(cum) - F.col(n), F.col(cum) - 1
    touches = lambda p: (
        F.floor(spot(p)).between(first, last) | F.ceil(spot(p)).between(first, last)
    )
    hits = ranked.filter(F.col(n) > 0).select(
        *keys, value, first.alias("_first"), last.alias("_last"), spot(F.lit(1.0)).alias("_end"),
        F.explode(F.filter(F.array(*[F.lit(float(p)) for p in probs]), touches)).alias("prob"),
    )
    at = F.col("prob") * F.col("_end")
    low, high = F.floor(at), F.ceil(at)
    picked = hits.groupBy(*keys, "prob").agg(
        F.max(F.when(low.between(F.col("_first"), F.col("_last")), F.col(value))).alias("_lo"),
        F.max(F.when(high.between(F.col("_first"), F.col("_last")), F.col(value))).alias("_hi"),
        F.max(at - low).alias("_frac"),
    )
    return picked.select(
        *keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile")
    )
