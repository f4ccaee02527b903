"""The tables of a folder, and prompt samples derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without that setting one beside the warehouse, which all nodes share too."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-checkpoints").rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def with_status(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as review samples: toxic ones are rejected, other good ones approved, the rest pending."""
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("pending")
    return docs.join(labels, "doc_id", "left").withColumn("status", status).drop("quality", "toxic")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_status(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: ``samples`` as a common table expression.
SAMPLES_SQL = """samples AS (
  SELECT d.*, CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'approved' ELSE 'pending' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
