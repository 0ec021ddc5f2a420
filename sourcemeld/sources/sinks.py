"""Target tables, the tables of a run and the audit trail, all as Parquet in a shared folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemeld.contract import Contract, Entity, column
from sourcemeld.operators.validation import TYPE_NAMES, as_typed

#: Commits after which the store merges its files by itself.
COMPACT_AFTER = 32


class Conflict(RuntimeError):
    """Somebody else has written to the same buckets in between; look again and decide anew."""


@dataclass(frozen=True)
class Snapshot:
    """The commits that make up a table: the last merged state and what came after it."""

    version: int
    merged: dict | None
    later: tuple[dict, ...]

    def entries(self) -> list[dict]:
        return [*([self.merged] if self.merged else []), *self.later]


class Folder:
    """The few file operations that DataFrames do not offer, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.gateway, self.jvm, self.conf = spark.sparkContext._gateway, spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        path, files = self._at(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def read(self, name: str) -> str | None:
        path, files = self._at(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, content: str) -> None:
        path, files = self._at(name)
        stream = files.create(path, True)
        try:
            stream.write(content.encode())
        finally:
            stream.close()

    def _rename(self, content: str, name: str, over: bool) -> None:
        """Written aside first, so that nobody reads half a file."""
        aside = f"aside/{uuid.uuid4().hex}"
        self.write(aside, content)
        source, _ = self._at(aside)
        target, files = self._at(name)
        files.mkdirs(target.getParent())
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kinds, int(over))
        if over:
            options[0] = kinds.OVERWRITE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.conf).rename(source, target, options)
        finally:
            files.delete(source, False)

    def swap(self, name: str, content: str) -> None:
        """The file holds the new content, whether it was there or not."""
        self._rename(content, name, over=True)

    def create(self, name: str, content: str) -> bool:
        """Whether the file was not there and now is."""
        try:
            self._rename(content, name, over=False)
        except Exception as failed:
            if "FileAlreadyExists" in str(failed):
                return False
            raise
        return True


class TargetStore:
    """One table of typed rows and one ledger per entity, written by commits that only add files.

    Rows lie in folders by a hash of their key, ledger entries by a hash of their idempotency key, so a batch opens
    only the folders that its keys can be in. A commit is a numbered file in the log that names its data; it counts from
    the moment that file exists, and the file is created only if nobody else has taken the number. A writer that
    finds it taken goes on to the next number, unless the other commit touched a bucket of its own: then it gets a
    ``Conflict`` and looks at the table again. After ``COMPACT_AFTER`` commits live rows are merged into one set of files.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.folder = Folder(spark, self.root)
        self._wanted = buckets

    # --- the log ---

    def buckets(self, entity: Entity) -> int:
        """Fixed by the first writer of an entity."""
        name = f"{entity.name}/buckets"
        if self.folder.read(name) is None:
            self.folder.create(name, str(self._wanted))
        return int(self.folder.read(name))

    def snapshot(self, entity: Entity) -> Snapshot:
        start = int(self.folder.read(f"{entity.name}/merged") or 0)
        numbers = [int(n.split(".")[0]) for n in self.folder.names(f"{entity.name}/log") if n.endswith(".json")]
        entries = [
            {"version": n, **json.loads(self.folder.read(f"{entity.name}/log/{n:012d}.json"))} for n in sorted(numbers) if n >= start
        ]
        merged = next((e for e in reversed(entries) if e["kind"] == "merge"), None)
        later = [e for e in entries if e["kind"] == "change" and (merged is None or e["version"] > merged["upto"])]
        return Snapshot(max(numbers, default=0), merged, tuple(later))

    def _commit(self, entity: Entity, entry: dict, base: int | None) -> int:
        """Number of the new commit; ``base`` is the last one that the writer has seen (None: any)."""
        version = self.snapshot(entity).version + 1 if base is None else base + 1
        content = json.dumps(entry, sort_keys=True)
        while not self.folder.create(f"{entity.name}/log/{version:012d}.json", content):
            other = json.loads(self.folder.read(f"{entity.name}/log/{version:012d}.json"))
            mine = set(map(tuple, entry.get("touched", ())))
            if base is not None and other["kind"] == "change" and mine & set(map(tuple, other["touched"])):
                raise Conflict(f"commit {version} of {entity.name} touches the same keys")
            version += 1
        return version

    # --- reading ---

    def _row_type(self, entity: Entity) -> T.StructType:
        lead = T.StructType.fromDDL("record_key string, idem_key string, record_id string, deleted boolean, version bigint")
        fields = [T.StructField(f.name, T.DataType.fromDDL(TYPE_NAMES[f.data_type])) for f in entity.fields]
        return lead.add("payload", T.StructType(fields)).add("bucket", T.IntegerType())

    _LEDGER_TYPE = (
        T.StructType().add("idem_key", T.StringType()).add("record_key", T.StringType()).add("version", T.LongType()).add("bucket", T.IntegerType())
    )

    def _load(self, entity: Entity, part: str, snapshot: Snapshot, buckets: list[int] | None = None) -> DataFrame:
        kind = self._row_type(entity) if part == "rows" else self._LEDGER_TYPE
        entries = [e for e in snapshot.entries() if part in e["parts"]]
        if not entries:
            return self.spark.createDataFrame([], kind)
        base = f"{self.root}/{entity.name}/{part}"
        kind = T.StructType(list(kind.fields)).add("commit", T.StringType())
        rows = self.spark.read.schema(kind).option("basePath", base).parquet(*[f"{base}/commit={e['data']}" for e in entries])
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        numbers = F.create_map(*[F.lit(x) for e in entries for x in (e["data"], e["version"])])
        return rows.withColumn("version", F.coalesce("version", F.element_at(numbers, F.col("commit")))).drop("commit")

    def _touched(self, keys: DataFrame, key: str, entity: Entity) -> list[int]:
        """Buckets of the keys of a batch; no more than there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket(key, entity)).distinct().collect())

    def _bucket(self, key: str, entity: Entity) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets(entity))).cast("int").alias("bucket")

    def changes(self, entity: Entity, keys: DataFrame | None = None) -> DataFrame:
        """(version, record_key, idem_key, record_id, deleted, payload) of all commits since the last merge, and the merged rows.

        With ``keys`` (record_key) only their buckets are opened.
        """
        buckets = None if keys is None else self._touched(keys, "record_key", entity)
        return self._load(entity, "rows", self.snapshot(entity), buckets)

    def alive(self, entity: Entity, keys: DataFrame | None = None) -> DataFrame:
        """The last change of every key, unless that was its deletion."""
        last = F.max_by(F.struct("idem_key", "record_id", "deleted", "version", "payload"), F.struct("version", "record_id")).alias("last")
        rows = self.changes(entity, keys).groupBy("record_key").agg(last).select("record_key", "last.*")
        return rows.where(~F.col("deleted")).drop("deleted")

    def current(self, entity: Entity, record_key: str | None = None) -> DataFrame:
        """The table as it is now, or its row of one key."""
        keys = None
        if record_key is not None:
            keys = self.spark.createDataFrame([(record_key,)], "record_key string")
        fields = [F.col("payload")[n].alias(column(n) if n == "record_key" else n) for n in entity.names]
        rows = self.alive(entity, keys).select("record_key", *fields)
        return rows if record_key is None else rows.where(F.col("record_key") == record_key)

    def listing(self, contract: Contract) -> dict[str, DataFrame]:
        """The current table of every entity."""
        return {e.name: self.current(e) for e in contract.entities}

    def ledger(self, entity: Entity, batch: DataFrame | None = None) -> DataFrame:
        """(idem_key, record_key) of what was written last and not deleted since; with ``batch`` (idem_key) of its buckets only."""
        snapshot = self.snapshot(entity)
        buckets = None if batch is None else self._touched(batch, "idem_key", entity)
        entries = self._load(entity, "ledger", snapshot, buckets)
        gone = self._load(entity, "rows", Snapshot(snapshot.version, None, tuple(e for e in snapshot.later if e["deletes"])))
        gone = gone.where("deleted").groupBy("record_key").agg(F.max("version").alias("__gone"))
        return (
            entries.join(gone, "record_key", "left")
            .where(F.col("__gone").isNull() | (F.col("version") > F.col("__gone")))
            .groupBy("idem_key")
            .agg(F.max_by("record_key", F.struct("version", "record_key")).alias("record_key"))
        )

    # --- writing ---

    def version(self, entity: Entity) -> int:
        return self.snapshot(entity).version

    def write(self, entity: Entity, accepted: DataFrame, base: int | None = None) -> int:
        """Append accepted records: record_key, idem_key, record_id and the contract fields, as canonical text or typed."""
        payload = F.struct(*[as_typed(accepted, f).alias(f.name) for f in entity.fields])
        rows = accepted.select("record_key", "idem_key", F.col("record_id").cast("string").alias("record_id"), payload.alias("payload"))
        return self._append(entity, rows.withColumn("deleted", F.lit(False)), base)

    def delete(self, entity: Entity, keys: DataFrame, base: int | None = None) -> int:
        nothing = F.lit(None).cast("string")
        rows = keys.select("record_key").distinct().select("record_key", nothing.alias("idem_key"), nothing.alias("record_id"), F.lit(True).alias("deleted"))
        return self._append(entity, rows.withColumn("payload", F.lit(None).cast(self._row_type(entity)["payload"].dataType)), base)

    def _save(self, rows: DataFrame, entity: Entity, part: str, data: str) -> DataFrame:
        """Files by bucket, about as large as the session's advisory size, hot buckets split."""
        path = f"{self.root}/{entity.name}/{part}/commit={data}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _append(self, entity: Entity, rows: DataFrame, base: int | None) -> int:
        data = uuid.uuid4().hex
        names = [f.name for f in self._row_type(entity) if f.name not in ("bucket", "version")]
        unnumbered = F.lit(None).cast("bigint").alias("version")
        written = self._save(rows.select(*names, unnumbered, self._bucket("record_key", entity)), entity, "rows", data)
        ledger = written.where("idem_key is not null and not deleted").select("idem_key", "record_key", unnumbered)
        ledger = self._save(ledger.select("*", self._bucket("idem_key", entity)), entity, "ledger", data)
        facts = written.agg(F.collect_set("bucket").alias("keys"), F.bool_or("deleted").alias("deletes")).first()
        idem = ledger.agg(F.collect_set("bucket")).first()[0]
        touched = [["rows", b] for b in sorted(facts["keys"])] + [["ledger", b] for b in sorted(idem)]
        entry = {"kind": "change", "data": data, "parts": ["rows", "ledger"], "touched": touched, "deletes": bool(facts["deletes"])}
        version = self._commit(entity, entry, base)
        if len(self.snapshot(entity).later) >= COMPACT_AFTER:
            self.compact(entity)
        return version

    def compact(self, entity: Entity) -> int:
        """Live rows and ledger entries in one set of files; commits that come in meanwhile stay on top of it."""
        snapshot = self.snapshot(entity)
        data = uuid.uuid4().hex
        rows = self._load(entity, "rows", snapshot)
        last = F.max_by(F.struct("idem_key", "record_id", "deleted", "version", "payload"), F.struct("version", "record_id")).alias("last")
        gone = F.max(F.when(F.col("deleted"), F.col("version"))).alias("gone")
        keys = rows.groupBy("record_key").agg(last, gone)
        live = keys.select("record_key", "last.*").where(~F.col("deleted"))
        names = [f.name for f in self._row_type(entity) if f.name != "bucket"]
        self._save(live.select(*names, self._bucket("record_key", entity)), entity, "rows", data)
        entries = self._load(entity, "ledger", snapshot).join(keys.where("gone is not null").select("record_key", "gone"), "record_key", "left")
        kept = entries.where("gone is null or version > gone").select("idem_key", "record_key", "version", self._bucket("idem_key", entity))
        self._save(kept, entity, "ledger", data)
        entry = {"kind": "merge", "data": data, "parts": ["rows", "ledger"], "upto": snapshot.version, "deletes": False}
        version = self._commit(entity, entry, None)
        self.folder.swap(f"{entity.name}/merged", str(snapshot.version + 1))  # where the log is read from; a hint only
        return version


class RunTables:
    """Derived tables of runs: a run's rows replace those of its earlier attempt, and readers never see half of them.

    Each attempt writes folders of its own; one small file per run names the attempt that counts and is
    swapped after all tables are complete.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.folder = Folder(spark, self.root)

    def save(self, run_id: str, tables: dict[str, DataFrame]) -> str:
        attempt = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.withColumn("run_id", F.lit(run_id)).write.parquet(f"{self.root}/{name}/{run_id}-{attempt}")
        self.folder.swap(f"current/{run_id}", attempt)
        return attempt

    def runs(self) -> list[str]:
        return [n for n in self.folder.names("current") if not n.startswith(".")]

    def read(self, name: str, runs: Iterable[str] | None = None) -> DataFrame:
        """Rows of a table with their ``run_id``, of all runs or the given ones."""
        wanted = self.runs() if runs is None else list(runs)
        there = set(self.folder.names(name))
        paths = [f"{r}-{self.folder.read(f'current/{r}')}" for r in wanted]
        paths = [f"{self.root}/{name}/{p}" for p in paths if p in there]
        if not paths:
            raise ValueError(f"no run has written {name}")
        return self.spark.read.option("mergeSchema", True).parquet(*paths)


AUDIT_SCHEMA = (
    "run_id string, created_at timestamp_ntz, record_id string, actor string, action string, reason string, data string"
)


class AuditTrail:
    """Append-only events, read in order of time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def append(self, events: DataFrame) -> None:
        names = T.StructType.fromDDL(AUDIT_SCHEMA)
        shaped = events.select(
            *[(F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in names]
        )
        shaped.write.mode("append").partitionBy("run_id").parquet(self.path)

    def read(self, run_id: str | None = None) -> DataFrame:
        events = self.spark.read.schema(AUDIT_SCHEMA).parquet(self.path)
        if run_id is not None:
            events = events.where(F.col("run_id") == run_id)
        return events.orderBy("created_at", "action", "record_id")
