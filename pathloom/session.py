"""Session factory with the settings the engine is tested under."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(app: str = "pathloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the session of the launcher is used instead.

    ``conf`` overrides single settings, with ``__`` standing for a dot.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, so that none needs it on its own path."""
    if spark.sparkContext.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="pathloom-")  # on the driver, whose server the workers fetch from
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = os.path.join(folder, "pathloom.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for inside, _, files in os.walk(here):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(inside, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        spark.sparkContext.addPyFile(at)
        _shipped.add(spark.sparkContext.applicationId)
