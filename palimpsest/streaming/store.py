"""Tables that grow by numbered batches, and memo tables of what was computed once.

A batch writes its own folder of a table and reads those of smaller numbers, so
a batch that is run again (after a crash, by its stream) replaces what its first
run left, and nothing is counted twice. What rows of several batches mean
together is for the reader to say: a first one, a last one, or a sum.

``compact`` lays all batches before a number into one folder. Readers take the
newest complete one and the batches after it; the older folders are no longer
read.
"""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.streaming.decoder import shared_folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, until the program ends: computed once, and no lineage behind it."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/memo"
    df.write.parquet(path)
    atexit.register(_removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then, and its folder with it
        if spark.sparkContext._jsc is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@dataclass(frozen=True)
class Store:
    """Tables under a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def write(self, name: str, number: int, df: DataFrame) -> None:
        """The rows of a batch, with its number as the column ``batch``."""
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        """The rows of all batches, or of those before a number; None where there are none yet."""
        known = self._folders(name)
        within = lambda n: before is None or n < before
        base = max((n for kind, n in known if kind == "upto" and within(n - 1)), default=None)
        used = [f"batch={n}" for kind, n in sorted(known) if kind == "batch" and within(n) and (base is None or n >= base)]
        paths = [f"{self.path}/{name}/{f}" for f in ([] if base is None else [f"upto={base}"]) + used]
        # the number is a column of the files: folders are given one by one, so their names are no partitions
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*paths) if paths else None

    def one(self, name: str, number: int) -> DataFrame:
        """The rows of one batch."""
        return self.spark.read.parquet(f"{self.path}/{name}/batch={number}")

    def last(self, name: str, before: int) -> DataFrame | None:
        """The rows of the last batch before a number, for tables whose batches each hold all that counts; None where there is none."""
        number = max((n for kind, n in self._folders(name) if kind == "batch" and n < before), default=None)
        return None if number is None else self.one(name, number)

    def compact(self, name: str, before: int, files: int = 1) -> None:
        """All rows of the batches before a number, in one folder of ``files`` files."""
        rows = self.read(name, before)
        if rows is not None:
            rows.repartition(files).write.mode("overwrite").parquet(f"{self.path}/{name}/upto={before}")

    def _folders(self, name: str) -> list[tuple[str, int]]:
        """(batch or upto, number) of each folder that was written to its end."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        whole = [p.getName().partition("=") for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return [(kind, int(n)) for kind, _, n in whole]


@dataclass(frozen=True)
class Memo:
    """What a batch looks up in, and adds to, the memo tables of a store."""

    store: Store
    number: int

    def filled(self, name: str, wanted: DataFrame, on: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of the memo for the keys in ``wanted`` (one row each). ``make`` computes those that no earlier batch has.

        Keys for which ``make`` gives no row are asked again with the next batch.
        """
        before = self.store.read(name, self.number)
        missing = wanted if before is None else wanted.join(before.select(*on).distinct(), on, "left_anti")
        self.store.write(name, self.number, make(missing))
        return self.store.read(name, self.number + 1).drop("batch").join(wanted.select(*on), on, "left_semi")
