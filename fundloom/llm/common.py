"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: blank and the five control characters 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: A word, as Java and RE2 both read it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. One is made up only in local mode, where it was left unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
    found = tempfile.mkdtemp(prefix="spark-fundloom-")
    spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders that materialize() has written and nobody has deleted yet, in order.
_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and lost executors cost nothing but a reread."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/fundloom-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._fundloom_path = path
    return out


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _written:
            _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that no plan still to be run reads."""
    for df in tables:
        delete(df.sparkSession, [df._fundloom_path])


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, materialized. All tables materialized on the way are deleted: the rows don't need them any more."""
    before = set(_written)
    out = materialize(make())
    delete(out.sparkSession, [p for p in _written if p not in before and p != out._fundloom_path])
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that isn't broadcast. Spark takes an exploded table to be as large as what it was exploded from, and so would send tables many times its limit to the driver."""
    return df.hint("merge")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def free_name(taken: Iterable[str], name: str) -> str:
    """name, or name with underscores in front, so that no column in taken has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, mod k; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(k))
