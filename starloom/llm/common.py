"""What the operators of this subpackage share: shared folders and column selection."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where the tables that ``materialise`` wrote lie.
WRITTEN: WeakKeyDictionary = WeakKeyDictionary()
#: Spark's setting of the bytes of an Arrow batch, and what ``bound_batches`` sets.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, one is made on a local master (tests); a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="starloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and rereads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote, once nothing that is still to run reads it."""
    for df in tables:
        path = WRITTEN.pop(df, None)
        if path:
            jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def bound_batches(spark: SparkSession) -> None:
    """Lets rows reach Python in batches of BATCH_BYTES or one row, unless the session names a limit of its own.

    A batch lies in each task's JVM outside the heap and in its Python worker; Spark's own limits are
    64 MB and 10,000 rows. Operators carry what spans batches, so results don't depend on the limit.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that other columns, whatever their names, can't clash."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
