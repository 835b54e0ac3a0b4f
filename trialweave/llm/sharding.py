"""Sharding by size-tiered compaction over immutable files and a versioned manifest.

A store is a folder with ``data/`` (Parquet files that are never changed), ``lists/`` (files
of JSON lines, never changed either: shards with rows, bytes and generation) and
``manifests/`` (one JSON file per version: the schema and the names of its lists).  A commit
writes lists of what it adds; a merge writes anew only those that name what it replaced, and
lists of shards at target size are read by readers alone.  So a version costs its changes, not
the store.  Arrivals are appended as small shards.  Compaction groups shards of a
similar size into tiers and rewrites runs of at least ``fan_in`` of a tier as files of about
``target_bytes``; shards at target size rest.  A version becomes visible only when its whole
manifest gets a name that nobody had: by a hard link on a local file system, by rename where
rename never replaces (HDFS), elsewhere by a create that must not replace.  So readers see all
of a change or nothing of it, and of two writers one loses and may try again.

``vacuum`` removes files that only older versions name, and files that no version ever named
once they are older than a grace period: until then they may belong to a write that is about
to be committed.

Only file names and counts are on the driver: a merge's own, or all that a reader asks for.  All file access is through Hadoop's file
system interface, so the store may lie anywhere Spark can write.

Defined results: an empty arrival (or an empty table of arrivals) adds no shard but a version;
a store without shards loads as no rows with the columns of the arrivals; rows are kept as they
are, with nulls, repeats and all columns.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most shards of a list.
LIST_SHARDS = 10_000
#: Columns that ``load`` adds.
LOADED = ("_shard", "_rows", "_bytes", "_generation", "_version")


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    rows: int
    bytes: int
    generation: int


@dataclass(frozen=True)
class ShardList:
    name: str
    shards: int
    small: int  # of them under half the target size


@dataclass(frozen=True)
class Manifest:
    version: int
    lists: tuple[ShardList, ...]
    schema: str = ""  # of the rows, as JSON


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, fan_in: int = 4, tier_base: float = 4.0) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.tier_base = target_bytes, fan_in, tier_base
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def latest(self) -> Manifest:
        versions = self.versions()
        return self.read(versions[-1]) if versions else Manifest(0, ())

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, version: int) -> Manifest:
        found = json.loads(self._text(self._name(version)))
        return Manifest(found["version"], tuple(ShardList(**x) for x in found["lists"]), found["schema"])

    def shards(self, manifest: Manifest | None = None, *, small: bool = False) -> list[Shard]:
        """Live shards of a version; ``small``: only lists with shards under half the target are read."""
        lists = (manifest or self.latest()).lists
        return [s for x in lists if x.small or not small for s in self._read_list(x)]

    def _read_list(self, one: ShardList) -> list[Shard]:
        return [Shard(**json.loads(line)) for line in self._text(f"{self.root}/lists/{one.name}").splitlines()]

    def _write_lists(self, shards: list[Shard]) -> tuple[ShardList, ...]:
        """Small shards and those at target size stand in lists of their own, ``LIST_SHARDS`` at most."""
        out = []
        for some in ([s for s in shards if self.tier(s) > 0], [s for s in shards if self.tier(s) == 0]):
            for i in range(0, len(some), LIST_SHARDS):
                part = some[i : i + LIST_SHARDS]
                name = f"{uuid.uuid4().hex}.jsonl"
                self._create(f"{self.root}/lists/{name}", "\n".join(json.dumps(asdict(s)) for s in part).encode())
                out.append(ShardList(name, len(part), sum(self.tier(s) > 0 for s in part)))
        return tuple(out)

    def _create(self, path: str, body: bytes) -> None:
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(body))
        finally:
            out.close()

    def _publish(self, name: str, body: bytes) -> None:
        """A whole file under a name that must be new, or Py4JJavaError or FileExistsError."""
        draft = f"{self.root}/manifests/.{uuid.uuid4().hex}"
        folder = self._path(f"{self.root}/manifests")
        self._fs.mkdirs(folder)
        place = self._fs.resolvePath(folder).toUri()
        if place.getScheme() not in ("file", "hdfs"):
            self._create(name, body)
            return
        self._create(draft, body)
        try:
            if place.getScheme() == "file":
                at = lambda p: self.spark._jvm.java.io.File(place.getPath(), p.rpartition("/")[2]).toPath()
                self.spark._jvm.java.nio.file.Files.createLink(at(name), at(draft))
            elif not self._fs.rename(self._path(draft), self._path(name)):
                raise FileExistsError(name)
        finally:
            self._fs.delete(self._path(draft), False)

    def commit(self, base: Manifest, added: list[Shard], *, removed: frozenset[str] = frozenset(), schema: str = "") -> Manifest:
        """Makes ``base`` with the shards ``added`` and without the paths ``removed`` the version after it,
        or raises Conflict."""
        kept, again = [], []
        for one in base.lists:
            own = self._read_list(one) if removed and one.small else []  # only small shards are ever replaced
            if any(s.path in removed for s in own):
                again += [s for s in own if s.path not in removed]
            else:
                kept.append(one)
        new = Manifest(base.version + 1, (*kept, *self._write_lists(again + added)), schema or base.schema)
        body = json.dumps({"version": new.version, "schema": new.schema, "lists": [asdict(x) for x in new.lists]}).encode()
        try:
            self._publish(self._name(new.version), body)
        except (FileExistsError, Py4JJavaError) as e:
            if not self._fs.exists(self._path(self._name(new.version))):
                raise
            raise Conflict(f"version {new.version} exists") from e
        return new

    # -- writing

    def _written(self, folder: str, generation: int) -> dict[str, list[Shard]]:
        """Files below ``folder`` by their partition folder; row counts from the files themselves."""
        at = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(at):
            return {}
        sizes: dict[str, int] = {}
        files = self._fs.listFiles(at, True)
        while files.hasNext():
            status = files.next()
            name = status.getPath().toString()
            if name.endswith(".parquet"):
                sizes[name[name.index(f"/{folder}/") + 1 :]] = status.getLen()
        if not sizes:
            return {}
        # Only the footers are read: a count per file.
        counts = self.spark.read.parquet(*(f"{self.root}/{p}" for p in sizes)).groupBy(F.col("_metadata.file_path").alias("p")).count().collect()
        rows = {r["p"][r["p"].index(f"/{folder}/") + 1 :]: r["count"] for r in counts}
        out: dict[str, list[Shard]] = {}
        for path, size in sorted(sizes.items()):
            if rows.get(path):
                out.setdefault(path.rpartition("/")[0], []).append(Shard(path, rows[path], size, generation))
        return out

    def append(self, df: DataFrame) -> Manifest:
        """One arrival as new shards of generation 0."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return self.commit(self.latest(), [s for x in self._written(folder, 0).values() for s in x], schema=df.schema.json())

    def append_each(self, df: DataFrame, arrival: Column) -> list[Manifest]:
        """Several arrivals in one pass over ``df``: a version for each value of ``arrival`` in order."""
        folder = f"data/{uuid.uuid4().hex}"
        number = next(f"_arrival{i}" for i in range(len(df.columns) + 1) if f"_arrival{i}" not in {c.lower() for c in df.columns})
        df.withColumn(number, arrival).write.partitionBy(number).parquet(f"{self.root}/{folder}")
        found = self._written(folder, 0)
        out = []
        for shards in [found[name] for name in sorted(found, key=lambda x: (len(x), x))] or [[]]:
            out.append(self.commit(self.latest(), shards, schema=df.schema.json()))
        return out

    # -- compaction

    def tier(self, shard: Shard) -> int:
        """0 for shards of at least half the target; each further tier is ``tier_base`` times smaller."""
        return max(0, math.ceil(math.log(self.target_bytes / 2 / max(1, shard.bytes), self.tier_base)))

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of similarly sized shards that are worth merging now, smallest tier first."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if (t := self.tier(s)) > 0:
                tiers.setdefault(t, []).append(s)
        return [sorted(x, key=lambda s: s.path) for t, x in sorted(tiers.items(), reverse=True) if len(x) >= self.fan_in]

    def compact(self) -> Manifest:
        """Merges all runs of the latest version in one commit."""
        base = self.latest()
        runs = self.runs(self.shards(base, small=True))
        gone, new = set(), []
        for run in runs:
            files = max(1, round(sum(s.bytes for s in run) / self.target_bytes))
            if files >= len(run):
                continue
            folder = f"data/{uuid.uuid4().hex}"
            self._rows(base, run).coalesce(files).write.parquet(f"{self.root}/{folder}")
            made = [s for x in self._written(folder, max(s.generation for s in run) + 1).values() for s in x]
            if sum(s.rows for s in made) != sum(s.rows for s in run):
                raise RuntimeError("a merge changed the number of rows")
            gone |= set(run)
            new += made
        if not gone:
            return base
        return self.commit(base, new, removed=frozenset(s.path for s in gone))

    def settle(self) -> Manifest:
        """Compacts until no tier has a run worth merging: what a merge makes may fill the next tier."""
        now = self.latest()
        while (new := self.compact()).version != now.version:
            now = new
        return now

    def vacuum(self, keep: int = 1, *, grace_s: float = 86_400.0) -> None:
        """Removes files that only versions before the last ``keep`` name, those manifests, and files
        over ``grace_s`` seconds old that no version names."""
        versions = self.versions()
        old, kept = [self.read(v) for v in versions[:-keep]], [self.read(v) for v in versions[-keep:]]
        lists = {x.name for m in kept for x in m.lists}
        dropped = {x.name: x for m in old for x in m.lists if x.name not in lists}
        named = {s.path for m in kept for s in self.shards(m)}
        past = {s.path for x in dropped.values() for s in self._read_list(x)} - named
        limit = (time.time() - grace_s) * 1000
        gone = []
        for part, now, before in (("data", named, past), ("lists", lists, set(dropped))):
            folder = self._path(f"{self.root}/{part}")
            files = self._fs.listFiles(folder, True) if self._fs.exists(folder) else None
            while files is not None and files.hasNext():
                status = files.next()
                path = status.getPath().toString()
                name = path[path.rindex(f"/{part}/") + 1 :].removeprefix("lists/")
                if name in before or name not in now and status.getModificationTime() < limit:
                    gone.append(path)
        for path in gone:
            self._fs.delete(self._path(path), False)
        for m in old:
            self._fs.delete(self._path(self._name(m.version)), False)

    # -- reading

    def _rows(self, manifest: Manifest, shards: list[Shard]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in shards))

    def load(self, manifest: Manifest | None = None) -> DataFrame:
        """Rows of a version, with the columns ``LOADED``; columns of the rows that are called so stay in
        the files but are left out here."""
        m = manifest or self.latest()
        if not m.schema:
            raise ValueError("the store has no version yet")
        shards = self.shards(m)
        table = self.spark.createDataFrame([(s.path, s.rows, s.bytes, s.generation) for s in shards], "_shard string, _rows long, _bytes long, _generation int")
        if shards:
            df = self._rows(m, shards).drop(*LOADED).withColumn("_shard", F.regexp_extract(F.col("_metadata.file_path"), "/(data/[^?]*)$", 1))
        else:
            df = self.spark.createDataFrame([], StructType.fromJson(json.loads(m.schema))).drop(*LOADED).withColumn("_shard", F.lit(""))
        return df.join(table, "_shard").withColumn("_version", F.lit(m.version))
