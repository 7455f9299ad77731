"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from churnlens.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(key: str = "doc_id"):
    """True where crc32 of the id's text is divisible by 5: rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def text_bytes(df: DataFrame, column: str) -> int:
    """Total UTF-8 bytes of a text column: one narrow aggregate, a single number on the driver."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)


def carried(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """(doc_key, body) of the rows, and with ``carry`` all other columns, whatever their names, in ``rest``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.col(id_col).cast("long").alias("doc_key"), F.col(text_col).cast("string").alias("body"),
                       *([F.struct(F.lit(1).alias("_"), *others).alias("rest")] if carry else []))


def restored(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` again, from rows with ``body`` and ``rest``."""
    return rows.select(*[(F.col("body") if c == text_col else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def with_rest(ddl: str, base: DataFrame) -> StructType:
    """The columns of ``ddl``, and ``body`` and ``rest`` if ``base`` carries its rows."""
    out = StructType.fromDDL(ddl)
    return StructType([*out.fields, base.schema["body"], base.schema["rest"]]) if "rest" in base.columns else out
