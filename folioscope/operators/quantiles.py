"""Exact grouped quantiles that never bring a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import materialised, measured_broadcast

BRACKET = 0.001
SKETCH_ACCURACY = 100_000
#: An interval with more distinct values than this is cut again before it is ranked, into about so many pieces.
RANKED, PIECES = 100_000, 256


def below(cuts: str) -> Column:
    """The number of cut points below the value."""
    return F.size(F.filter(cuts, lambda c: c < F.col("_v"))).cast("long")


def counted(values: DataFrame, keys: list[str], piece: str) -> DataFrame:
    """``(keys…, piece, _in, _distinct, _before)``: rows and distinct values in each piece, rows in those before it."""
    counts = values.groupBy(*keys, piece).agg(F.sum("_c").alias("_in"), F.count("*").alias("_distinct"))
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))


def narrowed(inside: DataFrame, targets: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Cut every interval into pieces of about equally many distinct values; keep those that hold a wanted rank.

    A piece is numbered within its interval's number, so a long holds some seven rounds: more distinct values than a
    double has.
    """
    keys, shares = [group, "_bin"], [i / PIECES for i in range(1, PIECES)]
    cuts = inside.groupBy(keys).agg(F.percentile_approx("_v", shares, F.lit(SKETCH_ACCURACY)).alias("_cuts"))
    finer = inside.join(measured_broadcast(cuts), keys).select(group, "_bin", "_v", "_c", below("_cuts").alias("_piece"))
    held = (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_in"))
    number = F.col("_bin") * PIECES + F.col("_piece")
    found = counted(finer, keys, "_piece").join(targets.drop("_distinct"), keys).where(held)
    found = found.select(
        group, number.alias("_bin"), "_slot", (F.col("_r") - F.col("_before")).alias("_r"), "_distinct"
    )
    found = materialised(found, "ranks")
    finer = finer.select(group, number.alias("_bin"), "_v", "_c")
    return finer.join(measured_broadcast(found.select(group, "_bin").distinct()), keys, "left_semi"), found


def group_quantiles(
    df: DataFrame, group: str, value: str, shares: Sequence[float], out_col: str = "q", ranked: int = RANKED
) -> DataFrame:
    """``(group, n, out_col)`` with the linearly interpolated quantiles of ``value`` as an array.

    The built-in exact percentile gathers the distinct values of a group in one buffer, which fails for a group
    holding a third of a large table. Here a mergeable sketch only proposes cut points around each quantile, exact
    counts then say in which interval a wanted rank lies. Such an interval (about 0.2 % of the group) is cut again,
    each time by exact counts, until it holds at most ``ranked`` distinct values; only those are ranked, whatever the
    size of the group. A poor sketch would make an interval wider, never a result wrong.
    """
    data = df.select(group, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & F.col(group).isNotNull()
    )
    # Two narrow columns, used three times below: written once, so that the measure is not computed again.
    data = materialised(data, "values")
    probes = sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-BRACKET, BRACKET)})
    cuts = data.groupBy(group).agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", [float(p) for p in probes], F.lit(SKETCH_ACCURACY)).alias("_cuts"),
    )
    cuts = measured_broadcast(cuts)
    values = data.groupBy(group, "_v").agg(F.count("*").alias("_c"))
    binned = values.join(cuts.select(group, "_cuts"), group).select(
        group, "_v", "_c", below("_cuts").alias("_bin")
    )

    # Exact number of rows before each interval, then the intervals that hold a wanted rank.
    per_bin = counted(binned, [group], "_bin")
    position = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    wanted = F.array(
        *[
            F.struct(F.lit(2 * i + j).alias("slot"), edge(p).cast("long").alias("rank"))
            for i, p in enumerate(position)
            for j, edge in enumerate((F.floor, F.ceil))
        ]
    )
    targets = (
        per_bin.join(cuts.select(group, "n"), group)
        .select(group, "_bin", "_before", "_in", "_distinct", F.explode(wanted).alias("_t"))
        .where((F.col("_t.rank") >= F.col("_before")) & (F.col("_t.rank") < F.col("_before") + F.col("_in")))
        .select(
            group, "_bin", F.col("_t.slot").alias("_slot"), (F.col("_t.rank") - F.col("_before")).alias("_r"), "_distinct"
        )
    )
    targets = materialised(targets, "ranks")
    inside = binned.join(measured_broadcast(targets.select(group, "_bin").distinct()), [group, "_bin"], "left_semi")
    while (targets.agg(F.max("_distinct")).first()[0] or 0) > ranked:
        inside, targets = narrowed(materialised(inside, "interval"), targets, group)
    targets = measured_broadcast(targets)
    running = Window.partitionBy(group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_end", F.sum("_c").over(running))
    hits = ranked.join(targets, [group, "_bin"]).where(
        (F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_c"))
    )
    picked = hits.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_v"))).alias("_m"))

    def interpolated(i: int):
        low, high = F.element_at("_m", F.lit(2 * i)), F.element_at("_m", F.lit(2 * i + 1))
        return low + (high - low) * (position[i] - F.floor(position[i]))

    return picked.join(cuts.select(group, "n"), group).select(
        group, "n", F.array(*[interpolated(i) for i in range(len(shares))]).alias(out_col)
    )
