"""Session settings the operators rely on; a caller's own settings win."""

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "trackloom", master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings as key=value."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
