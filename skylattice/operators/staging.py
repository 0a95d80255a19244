"""Tables that are written to the shared folder and read back, and joins whose keys may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most frequent keys of a lookup, which go by broadcast: what is left has at most 1/257 of the rows to a key.
HOTTEST = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="skylattice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skylattice/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def parts(spark: SparkSession) -> int:
    """Into how many parts small rows are dealt that take long to work on: Spark would join parts by their bytes and leave most cores idle."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


class Scratch:
    """Staged tables of one operator, deleted once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.tables: dict[int, DataFrame] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)], self.tables[id(back)] = path, back
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Only for tables that no unwritten DataFrame reads."""
        for t in tables:
            self.tables.pop(id(t), None)
            if path := self.paths.pop(id(t), None):
                delete(self.spark, path)

    def clear(self) -> None:
        self.drop(*list(self.tables.values()))


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """rows joined with small, which has few rows to a key, where a key may hold any share of rows.

    The HOTTEST keys of counts (keys, and their rows as n), a fixed number at every size, meet rows by broadcast; all others
    by a shuffled join. Keys are not null. rows is read twice: give a written table."""
    top = F.broadcast(counts.orderBy(F.desc("n"), *keys).limit(HOTTEST).select(*keys))
    hot = rows.join(F.broadcast(small.join(top, keys, "left_semi")), keys)
    return hot.unionByName(rows.join(top, keys, "left_anti").join(small.hint("merge"), keys))
