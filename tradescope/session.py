"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Split a hot join key at run time even where that costs one more shuffle, as it does
# between the items-orders join and a distinct count of orders.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Switch on adaptive execution with forced splitting of skewed join partitions.

    Partition counts, broadcast thresholds and memory stay as the cluster sets them.
    """
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark
