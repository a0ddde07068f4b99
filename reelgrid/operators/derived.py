"""Derived rows that are made anew only where their input or their maker changed.

Each stored row has the digest of what it was made from and of the maker's version. A run compares digests, makes the rows
that are new or stale, marks those whose input is gone, and adds these as one batch of changes; the reader's pointer moves
to that batch when all of it is written. A rebuild makes everything in a folder of its own beside the one in use, and the
pointer moves there. Whoever reads sees one whole state, before or after.

    home/build=K     a Store: bases, changes, compaction
    home/current     empty files named after a build and the number of its batches; the greatest counts
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators.merge import changed
from reelgrid.operators.rank import top_per_key
from reelgrid.sources.tables import kept
from reelgrid.sources.store import Store


class Derived:
    def __init__(self, spark: SparkSession, home: str, schema: str, key: str, make: Callable[[DataFrame], DataFrame], version: str, compared: list[str]):
        """schema: of the made rows, key included; make: from input rows to made rows; compared: columns whose change invalidates
        what was concluded from a row."""
        self.spark, self.home, self.schema, self.key = spark, home.rstrip("/"), schema, key
        self.make, self.version, self.compared = make, version, compared

    def _folder(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/current")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def current(self) -> tuple[int, int]:
        """The build in use and the number of its batches; (0, 0) before the first run."""
        fs, at = self._folder()
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        build, _, batches = max(names, default="0-0").partition("-")
        return int(build), int(batches)

    def _point(self, build: int, batches: int) -> None:
        """Makes an empty file, which is there or not; its name says it all, and the greatest name counts."""
        fs, at = self._folder()
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(at, f"{build:06d}-{batches:09d}"), True).close()

    def store(self, build: int) -> Store:
        latest = lambda rows: top_per_key(rows, [self.key], [F.desc("batch")])
        return Store(self.spark, f"{self.home}/build={build}", f"{self.schema}, digest string, gone boolean", self.key, latest)

    def read(self) -> DataFrame:
        build, batches = self.current()
        return self.store(build).read(batches).where("NOT gone").drop("digest", "gone")

    def _made(self, rows: DataFrame) -> DataFrame:
        digests = rows.select(F.col(self.key).alias("_key"), "digest")
        made = self.make(rows.drop("digest"))
        return made.join(digests, F.col(self.key) == F.col("_key")).drop("_key").withColumn("gone", F.lit(False))

    def _digested(self, inputs: DataFrame) -> DataFrame:
        whole = sorted(c for c in inputs.columns if c != self.key)
        digest = F.sha2(F.to_json(F.struct(F.lit(self.version).alias("_version"), *whole), {"ignoreNullFields": "false"}), 256)
        return inputs.where(F.col(self.key).isNotNull()).withColumn("digest", digest)

    def refresh(self, inputs: DataFrame) -> DataFrame:
        """Brings the stored rows up to inputs(key, ...), and returns (key, outcome) of those that were made or went: created,
        changed (in a compared column), unchanged (made anew with the same result) or gone. A key comes once; null keys are left out."""
        build, n = self.current()
        store = self.store(build)
        store.compact(n, list(range(store.buckets)))
        stored = store.read(n)
        known = stored.select(F.col(self.key).alias("_key"), F.col("digest").alias("_digest"), "gone")
        both = self._digested(inputs).join(known, F.col(self.key) == F.col("_key"), "left")
        stale = both.where("_key IS NULL OR gone OR digest <> _digest").drop("_key", "_digest", "gone")
        left = stored.where("NOT gone").join(inputs.select(self.key), self.key, "left_anti").withColumn("gone", F.lit(True))
        names = store.schema.names
        store.add(self._made(stale).select(*names).unionByName(left.select(*names)), n)
        was = stored.where("NOT gone").select(self.key, F.lit(True).alias("_there"), *self.compared)
        after = store.changes(n).alias("n").join(was.alias("o"), self.key, "left")
        outcome = F.when(F.col("n.gone"), "gone").when(F.col("o._there").isNull(), "created").when(changed("o", "n", self.compared), "changed").otherwise("unchanged")
        out = kept(after.select(self.key, outcome.alias("outcome")), "outcome")  # before a later run folds what it reads
        self._point(build, n + 1)
        return out

    def rebuild(self, inputs: DataFrame) -> None:
        """Makes all rows anew in a build of its own, then points to it. The build before stays until the next rebuild."""
        build, _ = self.current()
        fs, _ = self._folder()
        for old in (build - 1, build + 1):  # one that nobody reads any more, and what a rebuild that stopped has left
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/build={old}"), True)
        store = self.store(build + 1)
        # Making a row costs more than moving it: inputs that come in few files are dealt out first.
        dealt = self._digested(inputs).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.key)
        store.add(self._made(dealt).select(*store.schema.names), 0)
        self._point(build + 1, 1)
