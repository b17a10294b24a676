"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source of weight w (slots a cycle over the cycle's length) sends blocks of rows. Its block i is released at slot
floor(i / w) and must be sent before slot ceil((i + 1) / w); in every slot the released block with the earliest
deadline is sent. The weights sum to one, so every block keeps its window and after any number of slots each source
is less than one block from its share, as long as it has blocks left.

With whole numbers of slots the schedule repeats after one cycle, so only one cycle is computed, in one small row;
the slot of any block follows by arithmetic. A row's place in its source is counted in two levels: rows of a source
are ordered by a hash of their id, split into buckets of that hash, numbered within a bucket and shifted by the sizes
of the buckets before it. No task holds a source, however large.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Slots of a cycle at least, and for each source; rows of a block; rows of a bucket, about; buckets of a source at least and most.
CYCLE, SLOTS_A_SOURCE, BLOCK_ROWS, BUCKET_ROWS, BUCKETS_MIN, BUCKETS_MAX = 1000, 4, 64, 20_000, 64, 65_536
#: Slots of a cycle up to which its schedule is broadcast.
BROADCAST_SLOTS = 100_000


def _key(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def cycle_shares(sizes: DataFrame, weights: Mapping[str, float] | None) -> DataFrame:
    """src, slots, cycle: whole slots a cycle by largest remainders, one at least for each source with a weight.

    Without weights a source counts by the square root of its rows, which lifts small sources over their natural
    share. Given weights are taken relative to each other; sources that they do not name are not scheduled.
    """
    if weights is None:
        units = F.floor(F.sqrt(F.col("n").cast("double")) * 1000).cast("long")
    else:
        units = F.coalesce(*(F.when(F.col("src") == k, F.lit(round(w * 1e6)).cast("long")) for k, w in weights.items()), F.lit(0).cast("long")) if weights else F.lit(0).cast("long")
    all_rows = Window.partitionBy(F.lit(0))  # one row a source
    sized = sizes.select("src", units.alias("u")).where("u > 0").select("*", F.sum("u").over(all_rows).alias("total"), F.count(F.lit(1)).over(all_rows).alias("sources"))
    sized = sized.withColumn("cycle", F.greatest(F.lit(CYCLE).cast("long"), F.col("sources") * SLOTS_A_SOURCE))
    spare = F.col("cycle") - F.col("sources")
    sized = sized.select("src", "cycle", (F.expr("u * (cycle - sources) div total")).alias("whole"), F.expr("u * (cycle - sources) % total").alias("rest"), spare.alias("spare"))
    sized = sized.withColumn("left_over", F.col("spare") - F.sum("whole").over(all_rows))
    place = F.row_number().over(all_rows.orderBy(F.desc("rest"), "src"))
    return sized.select("src", (1 + F.col("whole") + F.when(place <= F.col("left_over"), 1).otherwise(0)).alias("slots"), "cycle")


def cycle_schedule(shares: DataFrame) -> DataFrame:
    """src, turn, slot: earliest deadline first among the released blocks, slot after slot of one cycle."""
    one = shares.groupBy(F.col("cycle")).agg(F.array_sort(F.collect_list(F.struct("src", "slots"))).alias("all"))

    def step(state: Column, t: Column) -> Column:
        sent, cycle = state["sent"], state["cycle"]
        window = F.transform(
            state["slots"],
            lambda c, i: F.when(F.floor(F.get(sent, i) * cycle / c) <= t, F.struct(F.ceil((F.get(sent, i) + 1) * cycle / c).alias("deadline"), i.alias("i"))),
        )
        picked = F.array(F.array_min(window)["i"])
        return F.transform(
            picked,
            lambda p: F.struct(
                cycle.alias("cycle"), state["slots"].alias("slots"), F.transform(sent, lambda n, i: F.when(i == p, n + 1).otherwise(n)).alias("sent"),
                F.concat(state["order"], F.array(p)).alias("order"),
            ),
        )[0]

    start = F.struct(
        F.col("cycle").alias("cycle"), F.transform("all", lambda x: x["slots"]).alias("slots"), F.transform("all", lambda x: F.lit(0).cast("long")).alias("sent"),
        F.array().cast("array<int>").alias("order"),
    )
    ran = one.select("all", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("cycle") - 1), start, step)["order"].alias("order"))
    slots = ran.select("all", F.posexplode("order").alias("slot", "i")).select(F.get("all", F.col("i"))["src"].alias("src"), F.col("slot").cast("long").alias("slot"))
    return slots.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("slot")) - 1).cast("long").alias("turn"), "slot")


def _timed(df: DataFrame, weights: Mapping[str, float] | None, id_col: str, source_col: str, block_rows: int) -> DataFrame:
    """df and mix_src, mix_block, mix_position, mix_slots, mix_cycle, mix_slot; every row once. df's names are c0, c1, …"""
    keyed = df.withColumns({"mix_src": _key(source_col), "mix_hash": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))})
    # buckets by the first four hex digits, in the order of the hash
    buckets = min(BUCKETS_MAX, max(BUCKETS_MIN, df.count() // BUCKET_ROWS))
    keyed = keyed.withColumn("mix_bucket", F.expr(f"cast(conv(substr(mix_hash, 1, 4), 16, 10) as long) * {buckets} div 65536"))
    counts = materialise(keyed.groupBy(F.col("mix_src").alias("src"), F.col("mix_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    shares = materialise(cycle_shares(counts.groupBy("src").agg(F.sum("n").alias("n")), weights), "mix-shares")
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(shares, "src", "left")
    offsets = materialise(offsets.select(F.col("src").alias("mix_src"), F.col("bucket").alias("mix_bucket"), "before", F.col("slots").alias("mix_slots"), F.col("cycle").alias("mix_cycle")), "mix-offsets")
    schedule = materialise(cycle_schedule(shares), "mix-schedule")
    size = schedule.count()
    # one row a slot of the cycle: some thousand, unless there are very many sources
    schedule = F.broadcast(schedule) if size <= BROADCAST_SLOTS else schedule
    inside = F.row_number().over(Window.partitionBy("mix_src", "mix_bucket").orderBy("mix_hash", id_col))
    ranked = keyed.withColumn("mix_inside", inside).join(offsets, ["mix_src", "mix_bucket"])
    place = F.col("before") + F.col("mix_inside") - 1
    ranked = ranked.withColumns({"mix_block": F.floor(place / block_rows), "mix_position": (place % block_rows).cast("int")})
    ranked = ranked.withColumn("mix_turn", F.col("mix_block") % F.col("mix_slots"))
    same = (F.col("mix_src") == F.col("src")) & (F.col("mix_turn") == F.col("turn"))
    return ranked.join(schedule, same, "left").withColumn("mix_slot", F.expr("mix_block div mix_slots * mix_cycle + slot"))


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of df: id, source, block, position, release, deadline, slot.

    Reading by slot, then position, gives the mix. When a source has run out its slots fall away and the others go on
    in proportion; no row is dropped or repeated. Null sources count as the empty one; within a source rows go by the
    MD5 of their id (null as the empty text), then id; repeated rows have places of their own; an empty table gives an
    empty one; sources without a weight have null in all but block and position. Further columns are not read.
    """
    timed = _timed(df.select(F.col(id_col).alias("c0"), F.col(source_col).alias("c1")), weights, "c0", "c1", block_rows)
    return timed.select(
        F.col("c0").alias(id_col), F.col("mix_src").alias("source"), F.col("mix_block").alias("block"), F.col("mix_position").alias("position"),
        F.expr("mix_block * mix_cycle div mix_slots").alias("release"), F.expr("((mix_block + 1) * mix_cycle + mix_slots - 1) div mix_slots").alias("deadline"),
        F.col("mix_slot").alias("slot"),
    )


def mixed_rows(df: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of df, all columns, in the order of the mix: range-partitioned and sorted by slot and position.

    Rows whose source has no weight come last.
    """
    order = [F.asc_nulls_last("mix_slot"), F.col("mix_position")]
    names = [f"c{i}" for i in range(len(df.columns))]  # whatever df calls its columns
    timed = _timed(df.toDF(*names), weights, names[df.columns.index(id_col)], names[df.columns.index(source_col)], block_rows)
    return timed.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).toDF(*df.columns)
