"""Keyed tables that micro-batches add to: sorted runs by level, merged on read.

A batch writes one run with the rows it changed, so what it writes follows the batch and not
the table. When a level has ``fan`` runs they merge into one run of the next level, so a row is
rewritten once per level. A version is a list of runs, written last: a batch that fails leaves
the version before it as it was, and one that is tried again overwrites its own run and list.

Rows lie in ``buckets`` by the hash of their first key column, so a read that wants few keys
reads their buckets only. It is the hash by which Spark deals rows: rows dealt by that column
over a multiple of ``buckets`` are written where they are. Stores that an older form wrote, with
another hash and their versions in ``lists``, are not read: a version that isn't there is an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, BUCKET = "_version", "_bucket"


@dataclass(frozen=True)
class KeyedStore:
    folder: str
    schema: str
    keys: tuple[str, ...]
    fan: int = 4
    buckets: int = 16

    def _bucket(self) -> Column:
        return F.pmod(F.hash(self.keys[0]), F.lit(self.buckets)).cast("int")

    def runs(self, spark: SparkSession, version: int) -> list[tuple[int, str]]:
        """(level, folder) of the runs of a version, oldest first; none before the first."""
        if version < 0:
            return []
        held = spark.read.schema("place INT, level INT, run STRING").parquet(f"{self.folder}/versions/{version}")
        return [(r["level"], r["run"]) for r in sorted(held.collect())]

    def _rows(self, spark: SparkSession, runs: Iterable[str]) -> DataFrame:
        schema = f"{self.schema}, {VERSION} INT, {BUCKET} INT"
        read = [spark.read.schema(schema).parquet(f"{self.folder}/runs/{run}") for run in runs]
        return reduce(DataFrame.unionByName, read)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Of each key the row of its last version: numbers are aggregated, rows are joined."""
        keys = [*self.keys, BUCKET]
        last = rows.groupBy(*keys).agg(F.max(VERSION).alias(VERSION))
        return rows.join(last, [*keys, VERSION])

    def read(
        self, spark: SparkSession, version: int, wanted: DataFrame | None = None, parts: int | None = None
    ) -> DataFrame:
        """The table as of a version; only rows with the first key column in ``wanted`` if given,
        dealt by that column over ``parts`` if given."""
        runs = [run for _, run in self.runs(spark, version)]
        if not runs:
            # limited to nothing, so that plans drop it
            return spark.createDataFrame([], self.schema).limit(0)
        rows = self._rows(spark, runs)
        if wanted is not None:
            wanted = wanted.select(self.keys[0]).distinct()
            # at most ``buckets`` numbers
            met = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
            rows = rows.where(F.col(BUCKET).isin(met)).join(wanted, self.keys[0], "left_semi")
        if parts is not None:
            rows = rows.repartition(parts, self.keys[0])
        latest = rows if len(runs) == 1 else self._latest(rows)
        return latest.drop(VERSION, BUCKET)

    def _write(self, rows: DataFrame, run: str, placed: bool = False) -> None:
        dealt = rows if placed else rows.repartition(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(16)))
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/runs/{run}")

    def write(self, rows: DataFrame, version: int, placed: bool = False) -> None:
        """Make ``version`` from the one before it and ``rows``, one for each key at most.

        ``placed``: they are dealt by the first key column over a multiple of ``buckets``.
        """
        spark = rows.sparkSession
        runs = self.runs(spark, version - 1)
        marked = rows.withColumn(VERSION, F.lit(version)).withColumn(BUCKET, self._bucket())
        self._write(marked, f"{version}-0", placed)
        runs.append((0, f"{version}-0"))
        level = 0
        while sum(at == level for at, _ in runs) >= self.fan:
            merged = [run for at, run in runs if at == level]
            self._write(self._latest(self._rows(spark, merged)), f"{version}-{level + 1}")
            # runs of a level stand together and behind those of higher levels
            runs = [x for x in runs if x[0] != level] + [(level + 1, f"{version}-{level + 1}")]
            level += 1
        named = [(place, at, run) for place, (at, run) in enumerate(runs)]
        listed = spark.createDataFrame(named, "place INT, level INT, run STRING").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.folder}/versions/{version}")
