"""As-of scans: what stands last before a place, and the sum of all before it, by one ordering instead of pairs.

Asks and events of the same keys are put into one table and ordered by their place. Each ask then reads what the rows
before it carry. A table of more than FEW rows is dealt out by range, so that neither a hot key nor a missing one puts
everything into one task: what a range carries at its end goes on to the ranges behind it (one row a range).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramloom.operators.counts import prefix_sums
from gramloom.sources.store import saved

#: Rows that one task may order by itself.
FEW = 200_000


def _together(asks: DataFrame, events: DataFrame, keys: list[str], at: str, place: str, more: list[str], asks_first: bool) -> DataFrame:
    """Both in one written table: keys, _pos, _kind, _salt (so that equal asks can lie in several ranges), _ask and the columns `more` of events."""
    kinds = {f.name: f.dataType for f in events.schema}
    left = asks.select(*keys, F.col(at).cast(kinds[place]).alias("_pos"), F.lit(0 if asks_first else 1).alias("_kind"), F.monotonically_increasing_id().alias("_salt"), F.struct(*asks.columns).alias("_ask"), *(F.lit(None).cast(kinds[c]).alias(f"_e_{c}") for c in more))
    right = events.select(*keys, F.col(place).alias("_pos"), F.lit(1 if asks_first else 0).alias("_kind"), F.lit(0).cast("long").alias("_salt"), F.lit(None).cast(left.schema["_ask"].dataType).alias("_ask"), *(F.col(c).alias(f"_e_{c}") for c in more))
    return saved(left.unionByName(right), "scan")


def _same(one: list[Column], two: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, (a.eqNullSafe(b) for a, b in zip(one, two, strict=True)), F.lit(True))


def carried(asks: DataFrame, events: DataFrame, keys: list[str], at: str, place: str, values: list[str], strictly: bool = False, few: int = FEW, most: str | None = None) -> DataFrame:
    """asks with `values` of the last event of the same keys whose place is not behind the ask's (strictly: before it);
    nulls if there is none. Of events at one place any one is the last. values don't have names of asks. With `most`, a
    column of events, it is the event with the largest of those (then the largest values) in place of the last one."""
    both = _together(asks, events, keys, at, place, list(dict.fromkeys([*([most] if most else []), *values])), strictly)
    told = [F.col(f"_e_{c}") for c in dict.fromkeys([*([most] if most else []), *values])]
    event = F.when(F.col("_ask").isNull(), F.struct(*keys, *told))
    # keys come first in the order and in the struct, so that the largest one so far is always one of the latest keys
    so_far = F.max(event) if most else F.last(event, ignorenulls=True)
    order = ["_pos", "_kind", "_salt"]
    if both.count() <= few:
        told = both.withColumn("_last", so_far.over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = saved(both.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "scan")
        ends = ranged.filter("_ask IS NULL").groupBy("_part").agg((F.max(event) if most else F.max_by(event, F.struct(*keys, "_pos"))).alias("_end"))
        every = ranged.select("_part").distinct().join(ends, "_part", "left")  # a row a range
        before = every.select("_part", (F.max("_end") if most else F.last("_end", ignorenulls=True)).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_in"))
        inside = Window.partitionBy("_part").orderBy(*keys, *order).rowsBetween(Window.unboundedPreceding, 0)
        told = ranged.withColumn("_last", so_far.over(inside)).join(F.broadcast(before), "_part").withColumn("_last", F.greatest("_last", "_in") if most else F.coalesce("_last", "_in"))
    same = _same([F.col(k) for k in keys], [F.col("_last")[k] for k in keys])
    return told.filter("_ask IS NOT NULL").select("_ask.*", *(F.when(same, F.col("_last")[f"_e_{c}"]).alias(c) for c in values))


def sums_before(asks: DataFrame, events: DataFrame, keys: list[str], at: str, place: str, value: str, name: str, few: int = FEW) -> DataFrame:
    """asks with `name`: the sum of `value` over the events of the same keys whose place is before the ask's."""
    both = _together(asks, events, keys, at, place, [value], True).withColumn("_v", F.coalesce(f"_e_{value}", F.lit(0)).cast("long"))
    order = ["_pos", "_kind", "_salt"]
    if both.count() <= few:
        run = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        told = both.withColumn(name, F.sum("_v").over(run))
    else:
        summed = saved(prefix_sums(both, [*keys, *order], "_v", "_from", "_to").select(*keys, "_ask", "_from"), "scan")
        begins = summed.groupBy(*keys).agg(F.min("_from").alias("_begin"))
        asked = summed.filter("_ask IS NOT NULL")
        if keys:
            on = _same([asked[k] for k in keys], [begins[k] for k in keys])
            told = asked.join(begins, on, "left").select(asked["_ask"], (F.col("_from") - F.col("_begin")).alias(name))
        else:
            told = asked.withColumn(name, F.col("_from"))
    return told.filter("_ask IS NOT NULL").select("_ask.*", F.col(name).cast("long").alias(name))
