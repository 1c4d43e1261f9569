"""Session settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch at most. Spark's own bound is 64 MB, of which a task holds several copies on each side.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

SETTINGS = {
    # EXIF dates and listing times carry no zone; results must not depend on the machine's.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    BATCH_BYTES: "8m",
}


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("filecover")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
