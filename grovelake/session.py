"""A Spark session with the defaults that the engine expects."""

from pyspark.sql import SparkSession


def session(name: str = "grovelake", **conf) -> SparkSession:
    """Case-sensitive identifiers, UTC, adaptive execution with skew joins."""
    b = SparkSession.builder.appName(name)
    defaults = {"spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (defaults | conf).items():
        b = b.config(k, str(v))
    return b.getOrCreate()
