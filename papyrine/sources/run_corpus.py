"""Results of evaluation runs as JSON: a folder a run, and a manifest that commits it.

A run writes its documents under a fresh attempt and then replaces the manifest by a rename, so a
killed write leaves files that no reader sees, and a run that is repeated leaves each document once.
Readers take the attempts that manifests name, whatever else lies there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"


class RunCorpus:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def write(self, run: str, results: DataFrame, key: str = "file") -> dict:
        """Write a run's results, one row a document; of rows that repeat a key one is kept."""
        attempt = uuid.uuid4().hex
        results.dropDuplicates([key]).write.json(f"{self.root}/run={run}/attempt={attempt}")
        written = self.spark.read.schema(results.schema).json(f"{self.root}/run={run}/attempt={attempt}")
        manifest = {"run": run, "attempt": attempt, "documents": written.count(), "schema": results.schema.json()}
        temporary = self._path(f"run={run}", f".{attempt}.tmp")
        stream = self._fs().create(temporary, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf).rename(temporary, self._path(f"run={run}", MANIFEST), options)
        return manifest

    def manifests(self) -> list[dict]:
        """One a committed run, by run."""
        if not self._fs().exists(self._path()):
            return []
        out = []
        for status in self._fs().globStatus(self._path("run=*", MANIFEST)) or []:
            stream = self._fs().open(status.getPath())
            try:
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return sorted(out, key=lambda m: m["run"])

    def read(self, schema: StructType | str | None = None) -> DataFrame | None:
        """(run, the columns of the runs) of every committed run; None without any. Columns that a run
        lacks are null; ``schema`` is read instead of the runs' own."""
        found = None
        for m in self.manifests():
            rows = self.spark.read.schema(schema or StructType.fromJson(json.loads(m["schema"]))).json(f"{self.root}/run={m['run']}/attempt={m['attempt']}")
            rows = rows.select(F.lit(m["run"]).alias("run"), "*")
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        return found

    def sweep(self) -> int:
        """Delete attempts that no manifest names; how many there were. Not while a run is writing."""
        named = {(f"run={m['run']}", f"attempt={m['attempt']}") for m in self.manifests()}
        left = [s.getPath() for s in self._fs().globStatus(self._path("run=*", "attempt=*")) or []]
        left = [p for p in left if (p.getParent().getName(), p.getName()) not in named]
        for path in left:
            self._fs().delete(path, True)
        return len(left)
