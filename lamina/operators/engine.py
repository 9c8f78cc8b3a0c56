"""A store in a folder: manifest of edits, logs of recent changes, sorted runs. Every change of state is a new file.

``manifest`` holds edits (``edit_id, action, number, level``), ``log`` the changes of generations that aren't flushed, ``runs``
one folder for each sorted run. Whoever opens the store folds the manifest, reads the live runs and replays the logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import files, mvcc
from lamina.sources.tables import write_sorted_run


class Store:
    """Changes are ``k, seq, op, v``; the key's and value's types are those of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        manifest = self._read("manifest", "edit_id bigint, action string, number bigint, level int, gen bigint")
        self.edits = manifest
        last = manifest.agg(F.max("edit_id"), F.max("number"), F.max("gen")).first()
        self.last_edit, self.last_run, self.flushed = (x or 0 for x in last)
        self.live = [(r["number"], r["level"]) for r in files.fold_edits(manifest.filter("number is not null")).join(manifest, ["number", "edit_id"]).select("number", "level").distinct().collect()]  # file metadata
        self.generation = max(self.flushed, self._log().agg(F.max("gen")).first()[0] or 0)

    def _read(self, what: str, schema: str) -> DataFrame:
        """All files of a folder; an empty table if there is none yet."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(str(p.toString()))

    def _log(self) -> DataFrame:
        """Changes that no run holds: those of generations behind the last flushed one."""
        return self._read("log", f"{self.schema}, gen bigint").filter(F.col("gen") > self.flushed)

    def write(self, changes: DataFrame) -> None:
        """Append a batch of changes to the log; it is applied whole once its files are committed."""
        self.generation += 1
        changes.withColumn("gen", F.lit(self.generation).cast("long")).write.mode("append").parquet(f"{self.path}/log")

    def append_edit(self, rows: list[tuple[str, int | None, int]]) -> None:
        """Append ``(action, number, level)`` to the manifest as one edit; it also names the last generation that runs hold."""
        self.last_edit += 1
        out = [(self.last_edit, action, number, level, self.flushed) for action, number, level in rows]
        self.spark.createDataFrame(out, "edit_id bigint, action string, number bigint, level int, gen bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def flush(self, parts: int = 1) -> None:
        """Write what the log holds as a sorted run of level 0 and read it back; an empty one is no file."""
        recent = self._log().drop("gen")
        wanted = recent.count()
        self.flushed = self.generation
        if not wanted:
            return
        self.last_run += 1
        path = f"{self.path}/runs/{self.last_run}"
        write_sorted_run(recent, path, parts)
        if self.spark.read.parquet(path).count() != wanted:
            raise ValueError(f"run {self.last_run} isn't whole")
        self.append_edit([("add", self.last_run, 0)])
        self.live.append((self.last_run, 0))

    def changes(self) -> DataFrame:
        """All versions: live runs and log."""
        out = self._log().drop("gen")
        for number, _ in self.live:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/runs/{number}"))
        return out

    def get(self, key: object, snapshot: int | None = None) -> DataFrame:
        """``k, seq, v`` of a key; the predicate on the key reaches the runs' scans, which skip by their key statistics."""
        return mvcc.as_of(self.changes().filter(F.col("k") == F.lit(key)), snapshot)

    def view(self, snapshot: int | None = None) -> DataFrame:
        return mvcc.as_of(self.changes(), snapshot)
