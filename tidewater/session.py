"""Session factory: UTC, adaptive execution, ANSI semantics, few shuffle partitions on one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewater", cores: int | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]" if cores else "local[*]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
