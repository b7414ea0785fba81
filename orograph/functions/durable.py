"""Tables that outlive the executors which made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of more bytes in memory are never sent to the driver to be broadcast. Spark goes by the size of their compressed files.
BROADCAST_BYTES = 10 << 20

#: The folder of a local session that names none, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a temporary folder if the master is local, so that there is one machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="orograph-")
    return _LOCAL[context.applicationId]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Written to the shared folder and read back: no lineage, and no partitioning that a planner could take for granted."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """``stored``, with rows counted as they are written: a table of many is joined by merging."""
    seen = Observation()
    back = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return back.hint("merge") if seen.get.get("n", 0) * _width(df.schema) > BROADCAST_BYTES else back


def _width(kind: T.DataType) -> int:
    """About how many bytes a value of the type takes in memory."""
    if isinstance(kind, T.StructType):
        return 16 + sum(_width(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return 16 + 4 * _width(kind.elementType)
    return 32 if isinstance(kind, T.StringType | T.BinaryType | T.MapType) else 8


def release(*tables: DataFrame) -> None:
    """Free the files of durable tables that nothing reads any longer: each is overwritten by an empty one."""
    for df in tables:
        if files := df.inputFiles():
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def durable_counting(df: DataFrame, condition: str, name: str = "table") -> tuple[DataFrame, int]:
    """``durable`` and how many rows meet the condition, counted by the same job that writes."""
    seen = Observation()
    counted = df.observe(seen, F.count_if(F.expr(condition)).alias("n"))
    return durable(counted, name), seen.get["n"]
