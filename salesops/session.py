"""Session helpers for tests, the bench and local runs.

On a cluster the session comes from the launcher; the library only reads its
settings.  ``local_session`` sets what a laptop run needs and leaves anything
already configured (e.g. ``spark.checkpoint.dir`` from spark-defaults) alone.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
    # PySpark records the Python call site of every Column it builds (for
    # error messages); that doubles the driver's JVM round trips while a
    # report's plan is built.  Plans are unchanged.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "salesops", **conf) -> SparkSession:
    """A local session; pass ``spark.checkpoint.dir`` to give it a scratch folder."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint location for written tables; the
    session must name that location, as only the cluster knows what is shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}"
