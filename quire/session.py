"""Session helpers: required settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; everything else is left to the cluster.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole texts travel to Python: batches bounded in bytes keep a worker small whatever the length of the texts
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session, which every executor can reach.

    ``spark.checkpoint.dir`` names it. Where that is unset, as in tests, the folder
    ``quire-checkpoints`` beside the warehouse serves; the warehouse is shared as well.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        folder = f"{warehouse.rpartition('/')[0]}/quire-checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under a new name in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor is recoverable."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
