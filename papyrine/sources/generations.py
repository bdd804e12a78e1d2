"""Tables whose columns changed over time, read as one.

A table has a list of migrations, each adding columns with a type and a default, or widening a
type. Every snapshot records the version it was written at. A reader of any version sees the
columns of that version: those that a snapshot lacks hold their defaults, those that it has beyond
the version are left out, and widened columns are cast. A type that cannot hold all of a snapshot's
values is refused before anything is read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types in the order in which a column may be widened (fixed values).
WIDER = [["tinyint", "smallint", "int", "bigint"], ["float", "double"], ["date", "timestamp_ntz"]]


@dataclass(frozen=True)
class Migration:
    """Columns added, {name: (type, default)}, and columns widened, {name: type}."""

    added: dict[str, tuple[str, Any]] = field(default_factory=dict)
    widened: dict[str, str] = field(default_factory=dict)


def widens(old: str, new: str) -> bool:
    return old == new or any(old in row and new in row and row.index(old) < row.index(new) for row in WIDER)


@dataclass(frozen=True)
class History:
    """A table's first columns, {name: type}, and its migrations."""

    first: dict[str, str]
    migrations: list[Migration]

    def columns(self, version: int) -> dict[str, tuple[str, Any]]:
        """{name: (type, default)} at a version; version 0 is before any migration."""
        out: dict[str, tuple[str, Any]] = {name: (kind, None) for name, kind in self.first.items()}
        for migration in self.migrations[:version]:
            for name, kind in migration.widened.items():
                if not widens(out[name][0], kind):
                    raise ValueError(f"{name}: {kind} does not hold every {out[name][0]}")
                out[name] = (kind, out[name][1])
            for name, added in migration.added.items():
                if name in out:
                    raise ValueError(f"{name} is added twice")
                out[name] = added
        return out

    @property
    def latest(self) -> int:
        return len(self.migrations)

    def write(self, rows: DataFrame, path: str, version: int | None = None) -> None:
        """Write a snapshot in the columns of ``version``, and its record beside it."""
        version = self.latest if version is None else version
        rows.select(*[F.col(n).cast(kind).alias(n) for n, (kind, _) in self.columns(version).items()]).write.parquet(f"{path}/rows")
        rows.sparkSession.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.text(f"{path}/record")

    def version_of(self, spark: SparkSession, path: str) -> int:
        return int(json.loads(spark.read.text(f"{path}/record").head()[0])["version"])

    def _cell(self, name: str, kind: str, default: Any, held: dict[str, tuple[str, Any]]) -> Column:
        if name not in held:
            return F.lit(default).cast(kind).alias(name)
        own = held[name][0]
        if not widens(own, kind):
            raise ValueError(f"{name}: {kind} does not hold every {own}")
        return F.col(name).cast(kind).alias(name)

    def read(self, spark: SparkSession, paths: list[str], version: int | None = None) -> DataFrame:
        """(generation, columns of ``version``) of all snapshots; ``generation`` is the version each was written at."""
        wanted = self.columns(self.latest if version is None else version)
        parts = []
        for path in paths:
            own = self.version_of(spark, path)
            held = self.columns(own)
            rows = spark.read.schema(", ".join(f"`{n}` {kind}" for n, (kind, _) in held.items())).parquet(f"{path}/rows")
            parts.append(rows.select(F.lit(own).alias("generation"), *[self._cell(n, kind, default, held) for n, (kind, default) in wanted.items()]))
        return reduce(DataFrame.unionByName, parts)
