"""A store of tables with one atomic pointer: whole versions for readers, optimistic commits for writers.

A version is a manifest, a small JSON file that names the folders of each table and holds the meta row. Data is written first, into folders
of its own; then the manifest of the next number is put in place by a rename that fails if that number is taken. So of two writers that
started from one version, one commits and the other gets Conflict, its folders named by no manifest; and whoever reads a version reads all of
its tables as they were committed together. Needed is a file system with an atomic rename that doesn't replace (HDFS; for local files a hard
link does it); object stores without one need a commit service.

A commit replaces a table (its folders are new ones) or appends to it (the folders before stay), so that a batch costs its own rows only;
folders of single partition values can be left out, so that expiry and purging touch old days only.
Folders that no kept manifest names go with vacuum().
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from datetime import UTC, date, datetime, timedelta
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidewell.functions.dates import DAY, instant, micros
from tidewell.operators.merge import PURGE_DAYS, kept, merge_counts, merge_snapshots, purge, sanity_check
from tidewell.scratch import written

#: The partition column of a commit's folder.
BATCH = "batch"
#: What a null's folder is called.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
SEEN_DAY = "seen_day"
#: Tasks that write a day's listings.
DAY_PARTS = 8
RUNS = "run string, started_at timestamp, finished_at timestamp, duration_ms bigint, fetched bigint, kept bigint, inserted bigint, updated bigint, expired bigint, refused string"


class Conflict(Exception):
    """Another commit came first."""


class Refused(Exception):
    """A snapshot that must not be published."""


@dataclass(frozen=True)
class Manifest:
    """tables: name -> {"folders": [...], "schema": JSON, "by": [partition columns]}; meta: what else is known of this version."""

    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


class Files:
    """The few file operations that a store needs, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Entries of a folder; none if there is no such folder."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def changed(self, name: str) -> float:
        return self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def put_new(self, name: str, text: str) -> bool:
        """Writes a whole file under a name that nothing has; False if it is taken."""
        draft = f"{name}.{uuid4().hex}.draft"
        stream = self.fs.create(self._path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            return self._linked(draft, name) if self.fs.getScheme() == "file" else self._renamed(draft, name)
        finally:
            self.fs.delete(self._path(draft), False)

    def _linked(self, draft: str, name: str) -> bool:
        try:
            os.link(*(self._path(x).toUri().getPath() for x in (draft, name)))
        except FileExistsError:
            return False
        return True

    def _renamed(self, draft: str, name: str) -> bool:
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.fs.getConf())
        try:
            files.rename(self._path(draft), self._path(name), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True


class Store:
    """Tables under one folder: `manifests/` has a file for each version, `data/<table>/batch=<id>` the rows of a commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.files.names("manifests") if x.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the newest one by default; version 0 is the empty store."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        return Manifest(**json.loads(self.files.text(f"manifests/{version:012}.json"))) if version else Manifest()

    def read(self, table: str, at: Manifest | None = None) -> DataFrame | None:
        """A table as a version has it; None if the version has no such table. Filters on partition columns leave out whole folders."""
        found = (at or self.manifest()).tables.get(table)
        if found is None:
            return None
        schema = StructType.fromJson(json.loads(found["schema"]))
        if not found["folders"]:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/data/{table}"
        every = StructType([*schema.fields]).add(BATCH, StringType())
        rows = self.spark.read.schema(every).option("basePath", base).parquet(*(f"{base}/{x}" for x in found["folders"]))
        return rows.select(*schema.fieldNames())

    def commit(self, base: Manifest, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
               drop: dict[str, list] | None = None, meta: dict | None = None, by: dict[str, list[str]] | None = None) -> Manifest:
        """The next version after base, or Conflict if another commit made it.

        by: partition columns of tables that are new. A table with a single one is held by folder of it, so that `drop` can leave out the
        folders of some values (before what `append` adds): other values' rows aren't read or written again.
        """
        batch, tables, append = f"{BATCH}={uuid4().hex}", dict(base.tables), append or {}
        for name, values in (drop or {}).items():
            (column,) = tables[name]["by"]
            gone = {f"{column}={NO_VALUE if v is None else v}" for v in values}
            tables[name] = tables[name] | {"folders": [x for x in tables[name]["folders"] if x.rpartition("/")[2] not in gone]}
        for name, df in {**(replace or {}), **append}.items():
            before = tables.get(name, {})
            fields = (by or {}).get(name) or before.get("by", [])
            df.write.partitionBy(*fields).parquet(f"{self.path}/data/{name}/{batch}")
            folders = [batch]
            if len(fields) == 1:
                folders = [f"{batch}/{x}" for x in self.files.names(f"data/{name}/{batch}") if "=" in x]
            earlier = before.get("folders", []) if name in append else []
            tables[name] = {"folders": [*earlier, *folders], "schema": before["schema"] if name in append and before else df.schema.json(), "by": fields}
        new = Manifest(base.version + 1, tables, base.meta | (meta or {}))
        if not self.files.put_new(f"manifests/{new.version:012}.json", json.dumps(asdict(new))):
            raise Conflict(f"version {new.version} was committed meanwhile")
        return new

    def vacuum(self, keep: int, before: datetime) -> list[str]:
        """Removes all but the `keep` newest manifests, and folders that none of those names and that are older than `before` (younger ones may be a commit under way)."""
        known = self.versions()
        for version in known[:-keep]:
            self.files.remove(f"manifests/{version:012}.json")
        named = {f"data/{t}/{b.partition('/')[0]}" for v in known[-keep:] for t, x in self.manifest(v).tables.items() for b in x["folders"]}
        folders = [f"data/{t}/{b}" for t in self.files.names("data") for b in self.files.names(f"data/{t}")]
        gone = [x for x in folders if x not in named and self.files.changed(x) < before.timestamp()]
        for folder in gone:
            self.files.remove(folder)
        return gone


# ---- snapshots of listings in a store, laid out by the UTC day on which they were last seen ----


def by_day(listings: DataFrame) -> DataFrame:
    """Adds seen_day, null for listings that were never seen; a day's rows are written by one task for each part of them."""
    days = F.floor(micros(F.col("lastSeenAt")) / DAY).cast("int")
    return listings.withColumn(SEEN_DAY, F.date_add(F.lit("1970-01-01").cast("date"), days)).repartition(F.col(SEEN_DAY), F.pmod(F.hash("id"), F.lit(DAY_PARTS)))


def _day(at: datetime) -> date:
    return (at.astimezone(UTC) if at.tzinfo else at).date()


def expire_stored(store: Store, cutoff: datetime) -> tuple[Manifest, int]:
    """Marks open listings last seen before the cutoff as expired, as expire_stale does without ids; how many there were.

    Days up to the cutoff's are looked at, and only those that have such listings are written again.
    """
    base = store.manifest()
    rows = store.read("listings", base).where(F.col(SEEN_DAY) <= F.lit(_day(cutoff)))
    stale = F.coalesce(micros(F.col("lastSeenAt")) < micros(instant(cutoff)), F.lit(False))
    found = rows.where(stale & ~F.col("isExpired")).groupBy(SEEN_DAY).count().collect()  # a row for each day
    if not found:
        return base, 0
    days = [r[SEEN_DAY] for r in found]
    changed = rows.where(F.col(SEEN_DAY).isin(days)).withColumn("isExpired", F.col("isExpired") | stale)
    return store.commit(base, append={"listings": changed}, drop={"listings": days}), sum(r["count"] for r in found)


def purge_stored(store: Store, now: datetime, days: int = PURGE_DAYS) -> tuple[Manifest, int]:
    """Removes listings that purge() would; how many there were. Days before the cutoff's go as folders, unread; only the cutoff's own day is written again."""
    base, cutoff = store.manifest(), now - timedelta(days=days)
    rows, edge = store.read("listings", base), F.lit(_day(cutoff))
    old = rows.where(F.col(SEEN_DAY) < edge).groupBy(SEEN_DAY).count().collect()  # from the files' footers
    last = rows.where(F.col(SEEN_DAY) == edge)
    left = purge(last, now, days)
    n_last, n_left = last.count(), left.count()
    gone = [r[SEEN_DAY] for r in old] + ([_day(cutoff)] if n_left < n_last else [])
    if not gone:
        return base, 0
    made = store.commit(base, append={"listings": left} if 0 < n_left < n_last else {}, drop={"listings": gone})
    return made, sum(r["count"] for r in old) + n_last - n_left


def run_row(spark: SparkSession, run: str, started: datetime, finished: datetime, counts: dict[str, int], refused: str | None = None) -> DataFrame:
    took = int((finished - started).total_seconds() * 1000)
    return spark.createDataFrame([(run, started, finished, took, *(int(counts[k]) for k in ("fetched", "kept", "inserted", "updated", "expired")), refused)], RUNS)


def ingest(store: Store, current: DataFrame, run: str, started: datetime, finished: datetime, fetched: int, retention: int = 21, stale: int = 3,
           tries: int = 5) -> Manifest:
    """Merges a run's listings into the stored ones, and commits listings, the run's row and the meta row together.

    After a conflict the merge starts again from what the other writer committed. A run that is stored already isn't merged again, so that a
    caller may repeat it. A snapshot that the gate refuses changes nothing but the history: its run is stored with the reason.
    """
    for _ in range(tries):
        base = store.manifest()
        runs, before = store.read("runs", base), store.read("listings", base)
        if runs is not None and runs.where(F.col("run") == run).limit(1).count():
            return base
        before = before if before is not None else by_day(current.limit(0))
        merged = written(merge_snapshots(before.drop(SEEN_DAY), current, finished, retention, stale), "merged")
        counts, n_kept = merge_counts(merged).first(), current.count()
        total = counts.added + counts.refreshed + counts.carried
        n = {"fetched": fetched, "kept": n_kept, "inserted": counts.added, "updated": counts.refreshed, "expired": counts.newly_expired}
        why = sanity_check(before.count(), total)
        # places in the merged order, so that the next run finds them
        rows = by_day(kept(merged).withColumn("_ord", F.col("_ord") + F.col("merge_side") * F.lit(1 << 40)).select(*current.columns))
        meta = {"last_ingest_at": finished.isoformat(), "job_count": total, "last_run": run} if why is None else {}
        try:
            made = store.commit(base, {"listings": rows} if why is None else {}, {"runs": run_row(store.spark, run, started, finished, n, why)}, meta=meta, by={"listings": [SEEN_DAY]})
        except Conflict:
            continue
        if why is not None:
            raise Refused(why)
        return made
    raise Conflict(f"{tries} tries, and each time another commit came first")


def health(store: Store, at: Manifest | None = None) -> dict:
    """What is stored: version, the meta row, how many runs there were and how many of them were refused."""
    at = at or store.manifest()
    runs = store.read("runs", at)
    n, refused = runs.agg(F.count(F.lit(1)), F.count("refused")).first() if runs is not None else (0, 0)
    return {"version": at.version, "job_count": 0, "last_ingest_at": None} | at.meta | {"runs": n, "refused": refused}
