"""CSV with quoted line breaks, read by many tasks.

A reader that follows quotes must start at the first byte, so a multi-line file is normally one task. Here every split
is read as plain lines. What a line does to the quoting is a function of two states (outside, inside quotes) that is
known without what comes before it; these functions are composed within a split and then over the splits of a file,
which tells for every line whether a record begins there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.session import materialised

# Places inside a line, as the fold over its quotes knows them.
FIELD_START, PLAIN, QUOTED, CLOSED = 0, 1, 2, 3


def ends_quoted(line: Column, inside: bool) -> Column:
    """1 if the line ends inside quotes when it begins inside or outside of them, else 0.

    The pieces between quotes are folded in order. A quote opens a field only at its start; in a quoted field it closes,
    unless another follows at once; elsewhere it is an ordinary character.
    """
    pieces = F.split(line, '"', -1)

    def after_text(state: Column, piece: Column) -> Column:
        outside = F.when(F.endswith(piece, F.lit(",")), FIELD_START).otherwise(PLAIN)
        return F.when((piece == "") | (state == QUOTED), state).otherwise(outside)

    def after_quote(state: Column) -> Column:
        return (
            F.when(state == FIELD_START, QUOTED).when(state == QUOTED, CLOSED).when(state == CLOSED, QUOTED)
            .otherwise(PLAIN)
        )

    begin = after_text(F.lit(QUOTED if inside else FIELD_START), F.get(pieces, F.lit(0)))
    end = F.aggregate(F.slice(pieces, 2, F.size(pieces)), begin, lambda state, p: after_text(after_quote(state), p))
    # Most lines have no quote; they leave the state as it is.
    return F.when(~line.contains('"'), int(inside)).otherwise((end == QUOTED).cast("int"))


def composed(order: Window, out: Column, inn: Column) -> tuple[Column, Column]:
    """``(fixed, flips)`` of all functions up to the current one.

    A function that ends alike from both states fixes the state, the others keep or flip it. So the state is the one at
    the last fixing function, or the state at the beginning, flipped as often as the flips since then say.
    """
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flips = F.sum(F.when(out > inn, 1).otherwise(0)).over(running)
    fixed = F.last(F.when(out == inn, (out + flips) % 2), ignorenulls=True).over(running)
    return fixed, flips


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, number, record)``: the records of all files, header lines included, empty lines left out.

    ``block`` is the first byte of the split in which the record begins, ``number`` counts from 1 in it. Lines are
    exchanged once, by split; a task orders one split. Only records of several lines are grouped.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value"),
    )
    lines = lines.withColumns({"_out": ends_quoted(F.col("value"), False), "_in": ends_quoted(F.col("value"), True)})
    in_block = Window.partitionBy("file", "block").orderBy("line")
    fixed, flips = composed(in_block, F.col("_out"), F.col("_in"))
    lines = lines.withColumns({"_fixed": fixed, "_flips": flips})
    lines = lines.withColumns(
        {
            "_fixed_before": F.lag("_fixed").over(in_block),
            "_flips_before": F.coalesce(F.lag("_flips").over(in_block), F.lit(0)),
        }
    ).drop("_out", "_in")
    lines = materialised(lines, "csv-lines")

    def state(fixed: str, flips: str, begin: Column) -> Column:
        return (F.coalesce(fixed, begin) + F.col(flips)) % 2

    # One row a split: its function, and how many records begin in it from either state.
    blocks = lines.groupBy("file", "block").agg(
        *[F.max_by(state("_fixed", "_flips", F.lit(s)), "line").alias(f"_end{s}") for s in (0, 1)],
        *[F.count_if(state("_fixed_before", "_flips_before", F.lit(s)) == 0).alias(f"_starts{s}") for s in (0, 1)],
    )
    in_file = Window.partitionBy("file").orderBy("block")
    fixed, flips = composed(in_file, F.col("_end0"), F.col("_end1"))
    blocks = blocks.withColumn("_after", (F.coalesce(fixed, F.lit(0)) + flips) % 2)
    blocks = blocks.withColumn("_begin", F.coalesce(F.lag("_after").over(in_file), F.lit(0)))
    blocks = blocks.withColumn("_starts", F.when(F.col("_begin") == 0, F.col("_starts0")).otherwise(F.col("_starts1")))
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("_starts") > 0, F.struct(F.col("block").alias("block"), F.col("_starts").alias("number")))
    blocks = blocks.select("file", "block", "_begin", F.last(held, ignorenulls=True).over(earlier).alias("_open"))

    placed = lines.join(blocks, ["file", "block"]).select(
        "file", "block", "line", "value", "_open",
        (state("_fixed_before", "_flips_before", F.col("_begin")) == 0).alias("_starts"),
        (state("_fixed", "_flips", F.col("_begin")) == 0).alias("_ends"),
    )
    number = F.sum(F.col("_starts").cast("long")).over(
        in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = placed.withColumn("number", number)
    whole = placed.where(F.col("_starts") & F.col("_ends")).select("file", "block", "number", F.col("value").alias("record"))
    carried = F.col("number") == 0
    parts = placed.where(~(F.col("_starts") & F.col("_ends"))).select(
        "file", F.when(carried, F.col("_open.block")).otherwise(F.col("block")).alias("first"),
        F.when(carried, F.col("_open.number")).otherwise(F.col("number")).alias("number"),
        F.struct("block", "line", "value").alias("part"),
    )
    joined = parts.groupBy("file", F.col("first").alias("block"), "number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["value"]), "\n").alias("record")
    )
    records = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return records.where(F.col("record") != "")


def csv_table(spark: SparkSession, path: str, columns: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """Header CSV with quoted line breaks, split into many tasks; ``columns`` maps header names to output names.

    Columns are found by name in each file's own header, so files may order them differently; a file without a column
    has nulls there. ``types`` (by output name, default string) are cast, null where a value does not fit. An empty
    field is null, quoted or not, as for Spark's reader. Records end with ``\\n`` or ``\\r\\n``.
    """
    records = materialised(csv_records(spark, path), "csv-records")
    place = F.struct("block", "number")
    headers = records.groupBy("file").agg(F.min_by("record", place).alias("header"), F.min(place).alias("_first"))
    headers = materialised(headers, "csv-headers")
    width = headers.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    schema = ", ".join(f"f{i} string" for i in range(width))
    options = {"quote": '"', "escape": '"', "multiLine": "true"}

    def fields(record: str) -> Column:
        parsed = F.from_csv(record, schema, options)
        return F.array(*[parsed[f"f{i}"] for i in range(width)])

    named = headers.select("file", "_first", fields(F.regexp_replace("header", "^\ufeff", "")).alias("_names"))
    rows = records.join(named, "file").where(place != F.col("_first")).select("_names", fields("record").alias("_f"))

    def value(name: str, kind: str) -> Column:
        found = F.get("_f", F.coalesce(F.array_position("_names", F.lit(name)), F.lit(0)).cast("int") - 1)
        return found if kind == "string" else found.try_cast(kind)

    kinds = types or {}
    return rows.select([value(c, kinds.get(out, "string")).alias(out) for c, out in columns.items()])
