"""Snapshots of registry tables: a generation a refresh, and a pointer that flips.

A refresh writes ``gen=<n>`` beside the current generation and then replaces the pointer file
by a rename, so readers see the old rows or the new ones. A failed or empty load keeps the
previous generation and its figures. The status table has one row a source.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrine.operators.postings import NameIndex


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def status(self, source: str) -> dict:
        """The source's record: status (never, running, ok, error, interrupted), generation,
        data_date, row_count, error."""
        path = self._path(source, "status.json")
        if not self._fs().exists(path):
            return {"source": source, "status": "never", "generation": None, "data_date": None, "row_count": None, "error": None}
        stream = self._fs().open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, source: str, record: dict) -> None:
        fs, temporary, path = self._fs(), self._path(source, ".status.tmp"), self._path(source, "status.json")
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(
            temporary, path, self._rename_overwrite()
        )

    def _rename_overwrite(self):
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        return options

    def refresh(self, source: str, load: Callable[[], tuple[DataFrame, str | None]], index: Callable[[DataFrame, str], NameIndex] | None = None) -> dict:
        """Load a new generation and flip to it; an error or no rows keeps the old one. ``index`` writes
        the generation's name index, given its rows and the index's path, before the pointer flips."""
        before = self.status(source)
        self._put(source, before | {"status": "running"})
        generation = (before["generation"] or 0) + 1
        began = time.time()
        try:
            rows, date = load()
            path = f"{self.root}/{source}/gen={generation}"
            rows.write.mode("overwrite").parquet(path)
            count = self.spark.read.parquet(path).count()
            if not count:
                raise ValueError("no rows")
            if index is not None:
                self._fs().delete(self._path(source, f"index-{generation}"), True)  # what a failed refresh left
                index(self.spark.read.parquet(path), f"{self.root}/{source}/index-{generation}")
            record = {"source": source, "status": "ok", "generation": generation, "data_date": date, "row_count": count, "duration_ms": int(1000 * (time.time() - began)), "error": None}
        except Exception as error:  # the loaders' errors are the source's status
            record = before | {"status": "error", "error": str(error).splitlines()[0][:500]}
        self._put(source, record)
        return record

    def refresh_all(self, loads: dict[str, Callable[[], tuple[DataFrame, str | None]]]) -> list[dict] | None:
        """Refresh the sources in order; a failing one does not stop the next. None where another
        run is going: the file system creates the run's mark for one caller only."""
        mark = self._path("refresh.running")
        self._fs().mkdirs(self._path())
        if not self._fs().createNewFile(mark):
            return None
        try:
            return [self.refresh(source, load) for source, load in loads.items()]
        finally:
            self._fs().delete(mark, False)

    def interrupt_running(self, sources: list[str]) -> None:
        """After a crash: runs that never ended are interrupted, and a new one may start."""
        self._fs().delete(self._path("refresh.running"), False)
        for source in sources:
            if (record := self.status(source))["status"] == "running":
                self._put(source, record | {"status": "interrupted"})

    def read(self, source: str) -> DataFrame | None:
        """The current generation, or None where the source was never loaded."""
        generation = self.status(source)["generation"]
        return None if generation is None else self.spark.read.parquet(f"{self.root}/{source}/gen={generation}")

    def index(self, source: str) -> NameIndex | None:
        """The name index of the current generation, or None where it has none."""
        generation = self.status(source)["generation"]
        if generation is None or not self._fs().exists(self._path(source, f"index-{generation}", "vocabulary", "_SUCCESS")):
            return None
        return NameIndex.read(self.spark, f"{self.root}/{source}/index-{generation}")

    def indexes(self, sources: list[str]) -> dict[str, NameIndex]:
        """Name indexes of the sources that have one, as search and screening take them."""
        found = {s: self.index(s) for s in sources}
        return {s: index for s, index in found.items() if index is not None}

    def tables(self, sources: list[str]) -> dict[str, DataFrame]:
        """Loaded sources only, as search and screening take them."""
        found = {s: self.read(s) for s in sources}
        return {s: df for s, df in found.items() if df is not None}

    def drop_old(self, source: str) -> None:
        """Delete generations older than the previous one."""
        current = self.status(source)["generation"] or 0
        for n in range(1, current - 1):
            self._fs().delete(self._path(source, f"gen={n}"), True)
            self._fs().delete(self._path(source, f"index-{n}"), True)
