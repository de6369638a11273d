"""Session helpers: the settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int = 8, app: str = "tablelab", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench. On a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config(CHECKPOINT_KEY, _own_folder())
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def _own_folder() -> str:
    """A folder for one process on one machine, gone when it ends."""
    path = tempfile.mkdtemp(prefix="tablelab-ckpt-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a throw-away one only where none is set (local mode)."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    current = sc.getCheckpointDir()
    if named is None and current is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        named = _own_folder()
    if current is None:
        sc.setCheckpointDir(named)
    return named or current


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a table that several later jobs read to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but as columns: later jobs read what they need.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
