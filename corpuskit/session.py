"""Session helpers: a configured session for scripts, and the shared scratch folder for jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "corpuskit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; on a cluster the submit command supplies the master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run, under the shared folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent on a single machine (master local) a temporary folder is used; a cluster
    without it is refused, since its executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpuskit-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
