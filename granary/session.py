"""Spark session with the settings the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "granary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC time; ``conf`` adds or replaces settings.

    Master and shuffle partitions are those of the cluster that submits, unless they are given. Without either, as for a
    plain ``python -m granary``, all cores of the machine are the master.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "SPARK_CONF_DIR" in os.environ
    if master or not submitted:
        builder = builder.master(master or "local[*]")
        settings = {"spark.ui.enabled": "false"} | settings
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
