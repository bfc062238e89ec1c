"""Pairs of numbers of one key that lie further apart than a band allows, found by value ranges.

Within a key the values at odds with v are all those beyond a limit that grows with v.
Distinct values are cut into sorted ranges, never by key alone; a value's partners start in the
range where the first value beyond its limit lies, found by binary search over the
ranges' largest values, and all later ranges of the key. Values then meet range by
range with an exact test. So a key may hold any share of the rows: a value is tested in its
own range, in the one where its partners start, and in ranges full of partners.

A range has about ``RANGE`` values, more where that were over ``MOST`` ranges. What the
driver learns are the ends of the ranges of keys that span several: two rows a range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

RANGE, MOST = 4096, 1 << 16


def beyond_difference(v: Column, most: float) -> Column:
    """The limit for |a - b| > most: no value at or under it can be at odds with v, but for rounding."""
    return v + most


def beyond_share(v: Column, most: float) -> Column:
    """The limit for |a - b| / ((|a| + |b|) / 2) > most, which never exceeds 2."""
    if most >= 2:
        return F.lit(float("inf"))
    up = (2 + most) / (2 - most)
    return v * F.when(v >= 0, up).otherwise(1 / up)


def apart(values: DataFrame, key: list[str], limit: Column, at_odds, fresh: str | None = None, size: int = RANGE) -> DataFrame:
    """(*key, v_lo, v_hi): the pairs of distinct values v of a key with v_lo < v_hi that at_odds(lo, hi) holds for.

    limit: of column v; at_odds() must hold for no value at or under it but by rounding, and for every value from the first one on that it holds for.
    fresh: a boolean column; only pairs with a fresh value are looked for. The values under a fresh one are found above it with all signs
    turned, so limit and at_odds() must not mind that."""
    if fresh is not None:
        up = _beyond(values, key, limit, at_odds, fresh, size)
        down = _beyond(values.withColumn("v", -F.col("v")), key, limit, at_odds, fresh, size)
        return up.unionByName(down.select(*key, (-F.col("v_hi")).alias("v_lo"), (-F.col("v_lo")).alias("v_hi"))).distinct()
    return _beyond(values, key, limit, at_odds, None, size)


def _beyond(values: DataFrame, key: list[str], limit: Column, at_odds, fresh: str | None, size: int) -> DataFrame:
    spark = values.sparkSession
    is_fresh = F.lit(True) if fresh is None else F.col(fresh)
    one = values.where("v is not null").groupBy(*key, "v").agg(F.max(is_fresh).alias("fresh"))
    slack = (F.abs("v") + F.abs(limit)) * 1e-12
    one = one.withColumn("limit", limit - F.when(slack < float("inf"), slack).otherwise(0.0))
    ranges = min(MOST, -(-one.count() // size))
    if ranges > 1:
        one = staged(one.repartitionByRange(ranges, *key, "v").withColumn("part", F.spark_partition_id()), "value-ranges")
        ends = one.groupBy(*key, "part").agg(F.max("v").alias("high"))
        rows = F.array_sort(F.collect_list(F.struct("part", "high")))
        wide = ends.groupBy(*key).agg(rows.alias("ends")).where(F.size("ends") > 1).collect()  # at most two rows a range
        known = {tuple(r[k] for k in key): (np.array([e.part for e in r.ends]), np.array([e.high for e in r.ends], float)) for r in wide}
        shared = spark.sparkContext.broadcast(known)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema)

        def starts(batches):
            for batch in batches:
                part, bound = batch.column("part").to_numpy(), batch.column("limit").to_numpy(zero_copy_only=False)
                first, last = part.copy(), part.copy()
                keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
                if shared.value and keys:
                    change = np.flatnonzero([True, *(a != b for a, b in zip(keys, keys[1:], strict=False))])
                    for a, b in zip(change, [*change[1:], len(keys)], strict=True):
                        if keys[a] in shared.value:
                            parts, high = shared.value[keys[a]]
                            at = np.searchsorted(high, bound[a:b], "right")
                            first[a:b] = np.append(parts, parts[-1] + 1)[at]
                            last[a:b] = parts[-1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], [*batch.schema.names, "first", "last"])

        asked = one.where("fresh").mapInArrow(starts, f"{kinds}, first int, last int")
        from_ = F.greatest("first", F.col("part") + 1)
        own = F.when(F.col("first") <= F.col("part"), F.array("part")).otherwise(F.array().cast("array<int>"))
        later = F.when(from_ <= F.col("last"), F.sequence(from_, F.col("last"))).otherwise(F.array().cast("array<int>"))
        low = asked.select(*key, F.col("v").alias("v_lo"), F.col("limit").alias("limit_lo"), F.explode(F.concat(own, later)).alias("part"))
    else:
        one = one.withColumn("part", F.lit(0))
        low = one.where("fresh").select(*key, F.col("v").alias("v_lo"), F.col("limit").alias("limit_lo"), "part")
    high = one.select(*key, "part", F.col("v").alias("v_hi"))
    pairs = low.join(high, [*key, "part"]).where((F.col("v_hi") > F.col("v_lo")) & (F.col("v_hi") > F.col("limit_lo")))
    return pairs.where(at_odds(F.col("v_lo"), F.col("v_hi"))).select(*key, "v_lo", "v_hi")
