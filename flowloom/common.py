"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DAY_MICROS = 86_400_000_000


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Modification time and length of a file or folder, which change when it is written."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    return status.getModificationTime(), status.getLen()


_SCHEMAS: dict[tuple, StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory. Its schema is read from the files once, and again when they have changed."""
    path = f"{sf_dir}/{name}.parquet"
    key = (path, *stamp(spark, path))
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def present(c: Column) -> Column:
    """True where a string is neither NULL nor ''."""
    return F.coalesce(c != "", F.lit(False))


def text(c: Column) -> Column:
    """NULL folded to ''."""
    return F.coalesce(c, F.lit(""))


def utc_day(micros: Column) -> Column:
    """yyyy-mm-dd of microseconds since the epoch, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(DAY_MICROS)).cast("int")).cast("string")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder where it names one; a local one only where that setting is absent and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="flowloom-checkpoint-"))


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new folder's name below the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{stem}-{uuid.uuid4()}"


#: Bytes above which an estimate of a table's size says nothing.
LARGEST = 1 << 62


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage in reliable storage, and what the planner estimates its size at where joins made that too large.

    A checkpoint keeps this estimate and a join multiplies those of its sides, so over rounds the number's length doubles
    until it fills the driver.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() < LARGEST:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), done._jdf.schema(), False), spark)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
