"""Operator 9: shards by a consistent-hash ring with virtual nodes and bounded loads.

A document's key names a cell of the ring; a virtual node of a shard stands in front of some cells, and a cell belongs
to the first virtual node clockwise. No shard may take more than its capacity (the mean load and a small slack): cells
that find their shard full go on clockwise, to the next shard that still has room. Whole cells move, so a document's
shard is decided by its cell, a change of the data moves few cells, and the loads are equal within the slack plus one
cell.

Everything is DataFrame work. Documents are summed up into at most ``2 ** cell_bits`` cells before anything else, so
the rounds of the ring walk work on that fixed number of rows, whatever the size of the input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialised

#: Cells of the ring: 2 to this power. A cell's share of the load is the precision of the balance.
CELL_BITS = 16


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", row_bytes: int = 16) -> DataFrame:
    """``key, size, text_crc32``: UTF-8 bytes of the text (null: none) plus ``row_bytes``."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias(key),
        (F.octet_length(content) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(content.cast("binary")).cast("long").alias("text_crc32"),
    )


def ring(spark, shards: int, virtual_nodes: int, cell_bits: int) -> DataFrame:
    """``cell, clockwise``: for every cell the shards in the order in which a clockwise walk first meets them.

    The ring depends on the parameters only, so its arcs are worked out here: an arc's list is its own node's shard
    and then the list of the next arc, and a first lap supplies the list that the last arc goes on with.
    """
    cells, nodes = 1 << cell_bits, {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.blake2b(b"%d/%d" % (shard, node), digest_size=8).digest()
            nodes.setdefault(int.from_bytes(digest, "little") % cells, shard)
    places, following = sorted(nodes), list(range(shards))
    for _ in range(2):
        arcs = []
        for i in reversed(range(len(places))):
            own = nodes[places[i]]
            following = [own] + [s for s in following if s != own]
            arcs.append((places[i - 1] + 1 if i else 0, places[i], following))
    arcs.append((places[-1] + 1, cells - 1, following))
    table = spark.createDataFrame([a for a in arcs if a[0] <= a[1]], "first int, last int, clockwise array<int>")
    return table.select(F.explode(F.sequence("first", "last")).alias("cell"), "clockwise")


def shard_by_ring(
    rows: DataFrame, shards: int = 40, key: str = "doc_id", size: str = "size", virtual_nodes: int = 64,
    slack: float = 0.001, cell_bits: int = CELL_BITS, salt: tuple[str, ...] = ("text_crc32", "size"),
) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    A null key is placed by the ``salt`` columns instead. Rows that are alike share a cell. An empty table gives an
    empty result. Other columns are kept; a column named like one of the new ones is replaced.
    """
    spark = rows.sparkSession
    position = F.when(F.col(key).isNull(), F.xxhash64(*salt)).otherwise(F.xxhash64(F.col(key)))
    kept = [c for c in rows.columns if c not in ("shard", "slot", "_cell")]
    placed = materialised(
        rows.select(*kept, F.shiftrightunsigned(position, 64 - cell_bits).cast("int").alias("_cell")), "sharding_rows"
    )
    loads = placed.groupBy("_cell").agg(F.sum(size).alias("load"), F.count("*").alias("n"))
    cells = loads.join(ring(spark, shards, virtual_nodes, cell_bits), loads["_cell"] == F.col("cell"))
    cells = materialised(cells.select("cell", "load", "n", "clockwise"), "sharding_cells")
    homes = bounded_walk(cells, shards, slack)
    # At most 2 ** cell_bits rows of three numbers: two megabytes by default.
    homes = F.broadcast(homes)
    in_cell = Window.partitionBy("_cell").orderBy(*[F.col(c) for c in dict.fromkeys((key, *salt))])
    return placed.withColumn("_rank", F.row_number().over(in_cell)).join(homes, F.col("_cell") == F.col("cell")).select(
        *kept, "shard", (F.col("before") + F.col("_rank") - 1).cast("long").alias("slot")
    )


def bounded_walk(cells: DataFrame, shards: int, slack: float) -> DataFrame:
    """``cell, shard, before``: where each cell comes to rest, and the rows that its shard holds before it.

    Each round sends the waiting cells to the first shard clockwise that is not full; a shard takes them in ring order
    until its capacity is reached. A round that leaves cells waiting has filled at least one more shard, so there are
    at most as many rounds as shards. What comes back to the driver is one number per shard.
    """
    total = cells.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    capacity = -(-int(total * (1 + slack)) // shards)
    held, settled, waiting = [0] * shards, None, cells
    in_shard = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(shards + 1):
        full = F.array(*[F.lit(load >= max(capacity, 1)) for load in held])
        so_far = F.array(*[F.lit(load).cast("long") for load in held])
        target = F.element_at(F.filter("clockwise", lambda s: ~F.get(full, s)), 1)
        round_ = waiting.withColumn("shard", target)
        round_ = round_.withColumn(
            "taken", F.coalesce(F.sum("load").over(in_shard), F.lit(0)) + F.get(so_far, F.col("shard")) < max(capacity, 1)
        )
        round_ = materialised(round_, "sharding_round")
        done = round_.where("taken").select("cell", "n", "shard")
        settled = done if settled is None else settled.unionByName(done)
        rest = 0
        for shard, taken, load, n in round_.groupBy("shard", "taken").agg(F.sum("load"), F.count("*")).collect():
            if taken:
                held[shard] += load
            else:
                rest += n
        if not rest:
            break
        waiting = round_.where(~F.col("taken")).drop("shard", "taken")
    before: Column = F.sum("n").over(in_shard)
    return settled.select("cell", "shard", F.coalesce(before, F.lit(0)).alias("before"))
