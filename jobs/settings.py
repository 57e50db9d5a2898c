"""What the jobs share: their small configuration files, sessions and logs."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession


def configured(job: str, path: str | None = None) -> dict:
    """The settings beside the job's code, with those of another file on the driver's machine on top."""
    own = json.loads(Path(job).with_suffix(".json").read_text())
    return own | (json.loads(Path(path).read_text()) if path else {})


def session(name: str) -> SparkSession:
    """The session of a command line; what it runs on is up to spark-submit."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
