"""Session settings the operators are tuned for; a cluster's own settings stay in force."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Days and times are UTC throughout.
    "spark.sql.session.timeZone": "UTC",
    # Re-plan at run time: merge small partitions, split skewed ones, switch join strategies.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM leaves methods above 8000 bytes uncompiled; long text expressions exceed that when
    # a whole stage becomes one method, and run faster as separate ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def session(builder: SparkSession.Builder | None = None) -> SparkSession:
    builder = builder or SparkSession.builder.appName("pricetrail")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
