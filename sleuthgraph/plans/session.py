"""Session settings the jobs rely on; all can be set on a running session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles a method above 8000 bytes of bytecode.  The event
    # rules are wide projections: with this limit they run as several compiled
    # methods instead of one interpreted whole-stage method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Projections this wide never fit one method; do not generate it in vain.
    "spark.sql.codegen.maxFields": "40",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan evenly over the cores, before the wide projections.

    Splits follow bytes, but a row group goes whole to one of them: a file of a few
    row groups, or one unsplittable piece, leaves most splits empty and the work to
    the others.  The rows as read are narrow, so dealing them costs little.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if splits < cores else 4 * splits)
