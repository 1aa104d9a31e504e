"""Values that are strict prefixes of other values, by sorting and comparing neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from parolumi.session import written


def shortened(values: DataFrame, value: str = "value") -> DataFrame:
    """(value, longer) of the different values that another one continues; longer is the
    next value in order.

    Whatever stands, in order, between a value and one that continues it begins with the
    value, too, so the next different value tells. Values are sorted by ranges over all
    tasks; where a range ends, its last value is compared with the next range's first,
    two rows a range.
    """
    spark = values.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, place = None, 0
        for f in frames:
            rows = []
            for part, v in zip(f["part"], f["value"]):
                if last is None:
                    rows.append((part, 0, v, None))
                elif v == last:
                    continue
                elif v.startswith(last):
                    rows.append((part, -1, last, v))
                last, place = v, part
            yield pd.DataFrame(rows, columns=["part", "edge", "value", "longer"])
        if last is not None:
            yield pd.DataFrame([(place, 1, last, None)], columns=["part", "edge", "value", "longer"])

    def once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a value that many rows have is sent once from each batch
        for f in frames:
            yield f.drop_duplicates()

    kept = values.select(F.col(value).alias("value")).where("value is not null and value <> ''").mapInPandas(once, "value string")
    ordered = kept.repartitionByRange(ranges, "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    found = written(ordered.mapInPandas(run, "part int, edge int, value string, longer string"), "neighbours")
    inner = found.where("edge = -1").select("value", "longer")
    edges = found.where("edge >= 0").withColumn("next", F.lead("value").over(W.orderBy("part", "edge"))).where("edge = 1 and next is not null and next <> value")
    return inner.unionByName(edges.where(F.expr("startswith(next, value)")).select("value", F.col("next").alias("longer")))
