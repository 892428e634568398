"""A keyed table that streams and writers by hand keep together: small commits, folded by key when read.

A commit lands only its own rows, as they come, and one numbered file in the log, which names every folder that makes up
the table from then on; the base, into which they are folded, is spread over folders by a hash of the key. The file is put only where its number is free, so of two writers
one lands and the other takes the next number; numbers are the table's own, and the number of a stream's batch stands
inside, so that a batch that runs again changes nothing. Rows wait behind the base until they amount to half of it, and
are then folded in; before that, small folders are laid together. What is written thus follows what came in, and the
folders stay few. Folders that none of the last commits names are removed.

Kinds of commits: put (rows that merge with the key's row), drop (keys that go; a later put starts anew), patch (columns
that aren't null replace the key's, keys without a row stay without) and reset (all keys go). Where `until` names a
column, a row ends when the table's clock, the latest time that any commit told, reaches it: readers don't see it, later
rows don't merge with it, and folding removes it. Rows without a key have no place and are left out.

The log needs a folder whose renames are atomic and replace nothing, as those of HDFS are, or a local one with hard links.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of waiting rows from which they are laid together, and commits from which they are folded in at the latest.
LAID, COMMITS = 8, 500
#: Log files that stay, so that a slow writer's number is still taken; seconds until a folder in no log counts as lost.
LOGGED, LOST_S = 100, 24 * 3600

Fold = Callable[[Column, Column], Column]


def newer(at: str, tie: str) -> Fold:
    """Of two rows of a key the one with the larger (at, tie); the later commit's if they are equal."""
    return lambda old, new: F.when(F.struct(new[at], new[tie]) >= F.struct(old[at], old[tie]), new).otherwise(old)


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


class State:
    """A table of one row per key; merge tells what a put makes of the key's row, which it replaces by default."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "key", merge: Fold | None = None, until: str | None = None, buckets: int = 16, keep: int = 4) -> None:
        self.spark, self.key, self.until, self.buckets, self.keep = spark, key, until, buckets, keep
        self.schema = StructType.fromDDL(schema)
        self.merge = merge or (lambda old, new: new)
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.files = path.getFileSystem(self.conf)
        self.folder = self.files.makeQualified(path).toString()
        self.files.mkdirs(self._path("_log"))

    # ------------------------------------------------------------ the log

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.files.listStatus(self._path("_log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> dict:
        """What the table consists of after a commit, the last one by default; the empty table before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "base": None, "deltas": [], "clock": None, "batches": {}, "meta": None, "kind": "none"}
        stream = self.files.open(self._path(f"_log/{version:020d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, draft, number) -> None:
        """The draft under a number that is free; an error where it is taken.

        A local rename looks first and then replaces, so two writers may both find a number free, and moves the checksum
        apart from its file; a link fails where the name is taken, and readers find no checksum beside it.
        """
        if self.files.getScheme() == "file":
            local = lambda path: self.jvm.java.io.File(path.toUri().getPath()).toPath()
            self.jvm.java.nio.file.Files.createLink(local(number), local(draft))
            return
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf).rename(draft, number, none)

    def _landed(self, snap: dict) -> bool:
        """Puts a log file under its number, unless that is taken."""
        draft, number = self._path(f"_log/.{uuid.uuid4().hex}"), self._path(f"_log/{snap['version']:020d}.json")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(snap).encode()))
        out.close()
        try:
            self._put(draft, number)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self.files.delete(draft, False)
        if max(self.versions()) >= snap["version"] + LOGGED:
            # The number was free only because its file is long gone.
            self.files.delete(number, False)
            return False
        return True

    def _commit(self, change: Callable[[dict], dict | None]) -> int | None:
        """Lands what `change` makes of the table, again on top of what another writer has landed meanwhile."""
        while True:
            snap = self.snapshot()
            new = change(snap)
            if new is None:
                return None
            new = snap | {"meta": None} | new | {"version": snap["version"] + 1}
            if self._landed(new):
                self._clean(new["version"])
                return new["version"]

    @staticmethod
    def _names(snap: dict) -> set[str]:
        return {d["path"] for d in snap["deltas"]} | ({snap["base"]["path"]} if snap["base"] else set())

    def _clean(self, version: int) -> None:
        """Removes folders that only commits before the last few name, those that no log names, and very old log files."""
        have = self.versions()
        kept = set().union(*(self._names(self.snapshot(v)) for v in have if v > version - self.keep))
        before = [v for v in have if version - self.keep - 3 < v <= version - self.keep]
        gone = set().union(*(self._names(self.snapshot(v)) for v in before)) - kept
        if version % LOGGED == 0:
            logged = set().union(*(self._names(self.snapshot(v)) for v in have))
            old = time.time() - LOST_S
            gone |= {n for s in self.files.listStatus(self._path("")) if (n := s.getPath().getName())[:2] in ("b-", "d-") and n not in logged and s.getModificationTime() / 1000 < old}
        for name in gone:
            self.files.delete(self._path(name), True)
        for v in have:
            if v <= version - LOGGED:
                self.files.delete(self._path(f"_log/{v:020d}.json"), False)

    # ------------------------------------------------------------ folders

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, prefix: str) -> dict:
        """Rows (key, _v, _clock, _kind, _row) of a base (b) in folders by bucket, of a commit (d) as they come, sorted by key."""
        name, rows = f"{prefix}-{uuid.uuid4().hex}", rows.withColumn("_bucket", self._bucket())
        if prefix == "b":
            rows.repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        else:
            rows.sortWithinPartitions(self.key).write.parquet(f"{self.folder}/{name}")
        held = self.spark.read.schema(self._layout()).parquet(f"{self.folder}/{name}").agg(F.count("*"), F.sort_array(F.collect_set("_bucket"))).first()
        return {"path": name, "rows": held[0], "buckets": held[1]}

    def _layout(self) -> StructType:
        key = self.schema[self.key]
        return StructType().add(key.name, key.dataType).add("_v", "long").add("_clock", "long").add("_kind", "string").add("_row", self.schema).add("_bucket", "integer")

    def _stored(self, entry: dict, only: list[int] | None) -> DataFrame:
        if not entry["buckets"]:
            return self.spark.createDataFrame([], self._layout()).drop("_bucket")
        df = self.spark.read.schema(self._layout()).parquet(f"{self.folder}/{entry['path']}")
        df = df if only is None else df.where(F.col("_bucket").isin(only))
        # Rows of one commit bear its number and clock only in the log.
        return df.select(self.key, F.coalesce("_v", F.lit(entry.get("version", 0))).alias("_v"), F.coalesce("_clock", F.lit(entry.get("clock")).cast("long")).alias("_clock"), "_kind", "_row")

    def _waiting(self, snap: dict, only: list[int] | None = None) -> DataFrame | None:
        out = None
        for entry in snap["deltas"]:
            df = self._stored(entry, only)
            out = df if out is None else out.unionByName(df)
        return out

    def _folded(self, rows: DataFrame) -> DataFrame:
        """(key, _row) of what each key's rows, at most one a commit, come to in the order of the commits."""
        kind = self.schema

        def step(old: Column, e: Column) -> Column:
            alive = old if self.until is None else F.when(F.coalesce(micros(old[self.until]) > e["_clock"], F.lit(True)), old)
            patched = F.struct(*[F.coalesce(e["_row"][c], alive[c]).alias(c) for c in kind.names])
            merged = F.when(alive.isNull(), e["_row"]).otherwise(self.merge(alive, e["_row"]))
            return F.when(e["_kind"] == "drop", F.lit(None).cast(kind)).when(e["_kind"] == "patch", F.when(alive.isNotNull(), patched)).otherwise(merged)

        each = F.array_sort(F.collect_list(F.struct("_v", "_clock", "_kind", "_row")), lambda a, b: F.when(a["_v"] < b["_v"], -1).when(a["_v"] > b["_v"], 1).otherwise(0))
        return rows.groupBy(self.key).agg(each.alias("_all")).select(self.key, F.aggregate("_all", F.lit(None).cast(kind), step).alias("_row")).where("_row is not null")

    def _rows(self, snap: dict, keys: DataFrame | None = None, only: list[int] | None = None) -> DataFrame:
        """(key, _row) of the table, or of some keys that lie in the buckets `only`; a row that is over is left out."""
        pick = lambda df: df if keys is None or df is None else df.join(keys.select(self.key), self.key, "left_semi")
        waiting = pick(self._waiting(snap, only))
        base = pick(self._stored(snap["base"], only)) if snap["base"] else None
        if waiting is None:
            out = base.select(self.key, "_row") if base is not None else self._stored({"buckets": []}, None).select(self.key, "_row")
        elif base is None:
            out = self._folded(waiting)
        else:
            # Only keys that have rows waiting are folded; the rest of the base is read as it is.
            touched = waiting.select(self.key).distinct()
            out = self._folded(base.join(touched, self.key, "left_semi").unionByName(waiting)).unionByName(base.join(touched, self.key, "left_anti").select(self.key, "_row"))
        if self.until is not None and snap["clock"] is not None:
            out = out.where(F.coalesce(micros(F.col(f"_row.{self.until}")) > snap["clock"], F.lit(True)))
        return out

    # ------------------------------------------------------------ readers

    def read(self, version: int | None = None) -> DataFrame:
        """The table after a commit, the last by default; the last few can be read."""
        return self._rows(self.snapshot(version)).select("_row.*")

    def get(self, *keys) -> DataFrame:
        """The rows of a few keys, from the folders they lie in, and from commits that wait, where files are sorted by key."""
        kind = self.schema[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType().add(self.key, kind))
        only = [r["b"] for r in wanted.select(self._bucket().alias("b")).distinct().collect()]
        return self._rows(self.snapshot(), wanted, only).select("_row.*")

    def changes(self, version: int) -> DataFrame:
        """(key, old, new) of the keys that a commit of rows touched: their rows before it and after it, null for none."""
        snap = self.snapshot(version)
        own = next(d for d in snap["deltas"] if d.get("version") == version)
        keys = self._stored(own, None).select(self.key).distinct()
        old, new = (self._rows(self.snapshot(v), keys, own["buckets"]).withColumnRenamed("_row", name) for v, name in ((version - 1, "old"), (version, "new")))
        return keys.join(old, self.key, "left").join(new, self.key, "left")

    def version_of(self, source: str, batch: int) -> int | None:
        """The commit that landed a source's batch, among those still logged."""
        return next((v for v in reversed(self.versions()) if (s := self.snapshot(v)).get("of") == [source, batch]), None)

    # ------------------------------------------------------------ writers

    def commit(self, rows: DataFrame, kind: str = "put", source: str | None = None, batch: int = 0, clock: int | None = None, meta: dict | None = None) -> int | None:
        """Lands rows, one per key, of the schema (of a drop: the key); returns the commit's number.

        A batch of a source that is already in, or lies before one that is, lands nothing and returns None. clock: microseconds.
        """
        done = lambda snap: source is not None and batch <= snap["batches"].get(source, -1)
        if done(self.snapshot()):
            return None
        held = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        key = F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)
        none = F.lit(None).cast("long")
        entry = self._write(rows.where(F.col(self.key).isNotNull()).select(key, none.alias("_v"), none.alias("_clock"), F.lit(kind).alias("_kind"), held.alias("_row")), "d")

        def change(snap: dict) -> dict | None:
            if done(snap):
                return None
            now = max((c for c in (snap["clock"], clock) if c is not None), default=None)
            delta = entry | {"version": snap["version"] + 1, "clock": now}
            return {"kind": kind, "deltas": [*snap["deltas"], delta], "clock": now, "batches": snap["batches"] | ({source: batch} if source else {}), "of": [source, batch], "meta": meta or snap["meta"]}

        version = self._commit(change)
        if version is None:
            self.files.delete(self._path(entry["path"]), True)
        else:
            self._tidy()
        return version

    def drop_keys(self, keys: DataFrame) -> int | None:
        return self.commit(keys.select(self.key).distinct(), "drop")

    def patch(self, rows: DataFrame) -> int | None:
        """Sets the columns of rows, one per key, where they aren't null, in the rows of those keys."""
        return self.commit(rows, "patch")

    def reset(self) -> int | None:
        return self._commit(lambda snap: {"kind": "reset", "base": None, "deltas": [], "of": None})

    def _tidy(self) -> None:
        """Lays small folders together, or folds all that waits into a new base; commits that land meanwhile stay behind it."""
        snap = self.snapshot()
        waiting, base = sum(d["rows"] for d in snap["deltas"]), snap["base"]["rows"] if snap["base"] else 0
        first = min((d["version"] for d in snap["deltas"]), default=snap["version"])
        after = lambda now: [d for d in now["deltas"] if d["version"] > snap["version"]]
        # A reset or another writer's tidying in between makes this one pointless.
        same = lambda now: now["base"] == snap["base"] and now["deltas"][: len(snap["deltas"])] == snap["deltas"]
        if len(snap["deltas"]) >= LAID and (2 * waiting >= base or snap["version"] - first >= COMMITS):
            none = F.lit(None).cast("long")
            made = self._write(self._rows(snap).select(self.key, F.lit(0).cast("long").alias("_v"), none.alias("_clock"), F.lit("put").alias("_kind"), "_row"), "b")
            landed = self._commit(lambda now: {"kind": "fold", "base": made, "deltas": after(now), "of": None, "meta": now["meta"]} if same(now) else None)
        elif len(few := _small(snap["deltas"])) >= LAID:
            made = self._write(self._waiting({"deltas": few}), "d") | {"version": max(d["version"] for d in few), "clock": None}
            landed = self._commit(lambda now: {"kind": "lay", "deltas": [*[d for d in snap["deltas"] if d not in few], made, *after(now)], "of": None, "meta": now["meta"]} if same(now) else None)
        else:
            return
        if landed is None:
            self.files.delete(self._path(made["path"]), True)


def _small(deltas: list[dict]) -> list[dict]:
    """Of folders, those of the lowest order of size (powers of eight) that has enough to be laid together."""
    orders: dict[int, list[dict]] = {}
    for d in deltas:
        orders.setdefault((max(d["rows"], 1).bit_length() - 1) // 3, []).append(d)
    return next((x for _, x in sorted(orders.items()) if len(x) >= LAID), [])
