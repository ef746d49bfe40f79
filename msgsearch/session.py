"""Session helpers: a tuned SparkSession and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Defaults for a session this package creates itself. A session handed in by the
# caller keeps its own settings.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins of the index tables on slab and id use their bucketing by slab as it is.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the package defaults; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName("msgsearch")
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and the session runs inside one machine is a
    local folder made and recorded in the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="msgsearch-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created or removed here."""
    return f"{shared_dir(spark)}/msgsearch/{label}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Write rows that several later steps read, and read them back.

    The steps share one computation, and a lost executor costs no more than reading again.
    """
    path = scratch_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def co_partitioned(spark: SparkSession):
    """Plans made inside may join on more columns than both sides are partitioned by.

    Of use for what is written inside; the session's own setting is back afterwards.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
