"""Tables in a folder that change together: snapshots, optimistic commits, and upserts that count once.

Data files are never changed.  A commit writes new folders and then one
manifest, ``log/<version>.json``, that names the parts of every table; until it
has its name, readers see the version before, and what a commit that died has
written is named by nobody.  Two commits at once take turns: the one that finds
its version taken works its changes out anew on the newer snapshot.

The file system must rename a file atomically and not onto another.  A manifest
names the parts there are, and for each stream of batches the last one; so its
size doesn't grow with the commits, as long as tables are compacted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELETED = "_deleted"


class Conflict(Exception):
    """Other commits took every version that a commit tried."""


@dataclass(frozen=True)
class Snapshot:
    """A version of all tables: each with its schema (DDL) and the folders of its parts, oldest first."""

    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Append:
    """``rows`` more; a function that gives them is called once what stands before in the changes is written.

    ``folder`` is where ``Store.stage`` has written them already.
    """

    rows: DataFrame | Callable[[], DataFrame]
    folder: str | None = None


@dataclass(frozen=True)
class Replace:
    rows: DataFrame


@dataclass(frozen=True)
class Swap:
    """``rows`` in place of some of a table's parts, at the place of the first."""

    rows: DataFrame
    parts: tuple[str, ...]
    folder: str | None = None


@dataclass(frozen=True)
class Note:
    """Values that go with a version, such as totals of a table."""

    values: dict


Changes = dict[str, Append | Replace | Swap | Note]


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Versions

    def _manifest(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}.json"

    def _exists(self, path: str) -> bool:
        return self._files.exists(self._at(path))

    def _read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def load(self, version: int) -> dict:
        """The manifest of a version."""
        return json.loads(self._read(self._manifest(version)))

    def load_file(self, name: str) -> dict:
        return json.loads(self._read(f"{self.path}/{name}"))

    def save_file(self, name: str, values: dict) -> str:
        """Write a new file of values that a manifest is going to name; its name."""
        stream = self._files.create(self._at(f"{self.path}/{name}"), False)
        stream.write(bytearray(json.dumps(values).encode()))
        stream.close()
        return name

    def version(self) -> int:
        """The last version.  A pointer says where to look from, so that no history is listed."""
        pointer = f"{self.path}/log/last"
        names = [x.getPath().getName() for x in self._files.listStatus(self._at(pointer))] if self._exists(pointer) else []
        last = max([int(x) for x in names if x.isdigit()], default=0)
        while self._exists(self._manifest(last + 1)):
            last += 1
        return last

    def snapshot(self, version: int | None = None) -> Snapshot:
        last = self.version() if version is None else version
        return Snapshot(last, **self.load(last)) if last else Snapshot()

    def publish(self, version: int, manifest: dict) -> bool:
        """Make ``manifest`` the given version; False if another commit has taken it."""
        temporary, final = self._at(f"{self.path}/log/tmp-{uuid.uuid4().hex}"), self._at(self._manifest(version))
        stream = self._files.create(temporary, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._files.exists(final) or not self._files.rename(temporary, final):
            self._files.delete(temporary, False)
            return False
        # a pointer is an empty file with the version's name; older ones go, and one that is missing costs a longer look only
        self._files.create(self._at(f"{self.path}/log/last/{version}"), True).close()
        self._files.delete(self._at(f"{self.path}/log/last/{version - 1}"), False)
        return True

    # Reading

    def parts(self, name: str, snapshot: Snapshot | None = None) -> list[DataFrame]:
        table = (snapshot or self.snapshot()).tables[name]
        return [self.spark.read.schema(table["schema"]).parquet(f"{self.path}/{p}") for p in table["parts"]]

    def read(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """A table as of a snapshot, the last one if none is given."""
        snapshot = snapshot or self.snapshot()
        table = snapshot.tables[name]
        if not table["parts"]:
            return self.spark.createDataFrame([], table["schema"])
        if len(table["parts"]) > 1 and table.get("by"):  # folders of a column's values aren't read over several roots
            return reduce(DataFrame.unionByName, self.parts(name, snapshot))
        return self.spark.read.schema(table["schema"]).parquet(*[f"{self.path}/{p}" for p in table["parts"]])

    # Writing

    def _write(self, name: str, rows: DataFrame, layout: dict[str, tuple[str, ...]]) -> str:
        folder = f"data/{name}/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        if name in layout:
            writer = writer.partitionBy(*layout[name])
        writer.parquet(f"{self.path}/{folder}")
        return folder

    def stage(self, name: str, rows: DataFrame, layout: dict[str, tuple[str, ...]] | None = None) -> tuple[str, DataFrame]:
        """A part that a commit is going to name, so that what else is made of it can read it: its folder and its rows."""
        folder = self._write(name, rows, layout or {})
        return folder, self.spark.read.schema(_ddl(rows)).parquet(f"{self.path}/{folder}")

    def commit(self, changes: Changes | Callable[[Snapshot], Changes], batch: tuple[str, int] | None = None, layout: dict[str, tuple[str, ...]] | None = None, tries: int = 20) -> int:
        """Make all changes at once; the version that has them.

        A function gets the snapshot that its changes start from and is called
        again if another commit comes first.  With ``batch``, a stream's name and
        a number, a number up to the stream's last one changes nothing: a batch
        counts once however often it is sent.  ``layout`` names columns that a table's files are parted by.
        """
        written: dict[int, str] = {}
        for _ in range(tries):
            before = self.snapshot()
            if batch is not None and before.batches.get(batch[0], -1) >= batch[1]:
                return before.version
            tables, notes = dict(before.tables), dict(before.notes)
            for name, change in (changes(before) if callable(changes) else changes).items():
                if isinstance(change, Note):
                    notes[name] = change.values
                    continue
                if callable(change.rows):
                    change = Append(change.rows())
                if id(change) not in written or callable(changes):
                    written[id(change)] = getattr(change, "folder", None) or self._write(name, change.rows, layout or {})
                old = tables.get(name, {"schema": _ddl(change.rows), "parts": [], "by": list((layout or {}).get(name, ()))})
                tables[name] = _changed(old, change, written[id(change)])
            batches = before.batches | ({batch[0]: batch[1]} if batch else {})
            if self.publish(before.version + 1, {"tables": tables, "batches": batches, "notes": notes}):
                return before.version + 1
        raise Conflict(f"no version was free after {tries} tries")

    # Upserts: a table of deltas, later parts over earlier ones

    def upsert(self, name: str, rows: DataFrame, keys: tuple[str, ...], order: Column | None = None, deleted: Column | None = None, batch: tuple[str, int] | None = None) -> int:
        """Put ``rows`` over those of equal keys; ``deleted`` says which take a key away.

        Of rows with equal keys in one batch the last by ``order`` counts; without it, keys must differ.
        """
        marked = rows.withColumn(DELETED, F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False))
        if order is not None:
            kept = F.max_by(F.struct(*marked.columns), F.struct(order))
            marked = marked.groupBy(*keys).agg(kept.alias("_row")).select("_row.*")
        return self.commit({name: Append(marked)}, batch)

    def latest(self, name: str, keys: tuple[str, ...], snapshot: Snapshot | None = None) -> DataFrame:
        """The table that upserts made: one row for each key, the newest, unless that took it away.

        Keys are merged by an aggregate, which combines before the shuffle.
        """
        return self._merged(name, keys, snapshot).where(~F.col(DELETED)).drop(DELETED)

    def _merged(self, name: str, keys: tuple[str, ...], snapshot: Snapshot | None) -> DataFrame:
        snapshot = snapshot or self.snapshot()
        if len(snapshot.tables[name]["parts"]) < 2:
            return self.read(name, snapshot)
        numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(self.parts(name, snapshot))]
        columns = numbered[0].drop("_part").columns
        rows = reduce(DataFrame.unionByName, numbered)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_part").alias("_row")).select("_row.*")

    def compact(self, name: str, keys: tuple[str, ...]) -> int:
        """Make the deltas of a table one part without what was taken away; readers of older snapshots still have theirs."""
        return self.commit(lambda s: {name: Replace(self._merged(name, keys, s).where(~F.col(DELETED)))})

    def expire(self, keep: int = 1) -> int:
        """Delete manifests but the last ``keep`` and data folders that none of those names; how many folders went.

        To be called while no commit runs, as its folders have no manifest yet.
        """
        last = self.version()
        named = {p for v in range(max(1, last - keep + 1), last + 1) for t in self.snapshot(v).tables.values() for p in t["parts"]}
        gone = 0
        data = self._at(f"{self.path}/data")
        for table in self._files.listStatus(data) if self._files.exists(data) else []:
            for part in self._files.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{part.getPath().getName()}" not in named:
                    self._files.delete(part.getPath(), True)
                    gone += 1
        for x in self._files.listStatus(self._at(f"{self.path}/log")):
            name = x.getPath().getName().removesuffix(".json")
            if name.isdigit() and int(name) <= last - keep:
                self._files.delete(x.getPath(), False)
        return gone


def _changed(table: dict, change: Append | Replace | Swap, folder: str) -> dict:
    if isinstance(change, Replace):
        return {**table, "schema": _ddl(change.rows), "parts": [folder]}
    if isinstance(change, Append):
        return {**table, "parts": [*table["parts"], folder]}
    at = table["parts"].index(change.parts[0])
    left = [p for p in table["parts"] if p not in change.parts]
    return {**table, "parts": [*left[:at], folder, *left[at:]]}


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
