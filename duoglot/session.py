"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Query terms are pushed to the postings scan as an IN list; the default of 10
    # would turn a longer list into a plain min/max range.
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
    # Tables bucketed by doc_id also serve joins on (query_id, doc_id) without a shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app_name: str = "duoglot", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings this library is tuned for; ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Without that setting, the folder given to ``setCheckpointDir``. Only a session that runs
    in one process (``local``, ``local[n]``) may fall back to a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not shared:
        shared = context.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="duoglot-"))
        shared = context.getCheckpointDir()
    return shared.rstrip("/")
