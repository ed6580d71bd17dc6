"""Published tables: every load writes a new directory, checks it, and then records it as the current version.

A failed load leaves the earlier version current.  The record of versions is a table itself.
"""

from __future__ import annotations

import datetime
import json
import uuid
from typing import NamedTuple
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators import load
from tabloom.operators.mapping import apply_mapping
from tabloom.operators.skew import keep_by_key
from tabloom.session import materialized, short_methods
from tabloom.sources import file_stats
from tabloom.types import ROW_HASH, ColumnSpec

WHOLE_MODES = ("replace", "copy", "derived", "compact")  # that carry no row over as updated
ATTEMPTS = 5  # of a load that others overtake

VERSIONS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("load_id", T.StringType()),
        T.StructField("paths", T.ArrayType(T.StringType())),
        T.StructField("mode", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("inserted", T.LongType()),
        T.StructField("updated", T.LongType()),
        T.StructField("schema_json", T.StringType()),
        T.StructField("published_at", T.TimestampNTZType()),
    ]
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# One row per file load, one per refresh of a source, one per loaded file.
EVENTS = _schema(table_name=T.StringType(), load_id=T.StringType(), detail=T.StringType(), logged_at=T.TimestampNTZType())
SOURCES = _schema(
    table_name=T.StringType(), load_id=T.StringType(), status=T.StringType(), watermark=T.StringType(), row_count=T.LongType(),
    error=T.StringType(), logged_at=T.TimestampNTZType(),
)
FILES = _schema(
    table_name=T.StringType(), run_id=T.StringType(), file=T.StringType(), size_bytes=T.LongType(), line_count=T.LongType(), sum_high=T.StringType(), sum_low=T.StringType(),
    load_id=T.StringType(),
)
DROPPED = "drop"
FILE_BYTES = 128 << 20


class State(NamedTuple):
    """Number of the last version of a table (0 before the first), that version unless it is a drop, and whether a load
    id is recorded for the table."""

    version: int
    newest: Row | None
    done: bool


class Kept(NamedTuple):
    """Files of the version before that stay as they are, and the rows they hold."""

    paths: list[str]
    rows: int


class IntegrityError(RuntimeError):
    """A written table does not hold the rows that were sent to it."""


class OvertakenError(RuntimeError):
    """Another load published a version since this one read the table."""


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)


class TableStore:
    """Versioned tables below one folder that all executors share.

    A version is a list of folders and files.  A load writes one folder with what it changes: new rows, and the rows of
    those files it has to take rows out of.  All other files of the version before stay in the list.
    """

    def __init__(self, spark: SparkSession, root: str, owner=None):
        """``owner(path, load_id)`` gives the load that owns a new version's number, the same one to all that ask; the default
        creates a file through Spark's checkpoint file manager, which can be set for stores without exclusive creation."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.owner = owner or self._created
        for log in ("_versions", "_events", "_sources", "_files"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{log}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def _append(self, log: str, entry: tuple, schema: T.StructType) -> None:
        """Add an entry to a log.  A log has a folder per table, so that a look at one table reads that folder alone, and in
        it one per entry, so that loads which end at the same time do not share a working folder."""
        folder = f"{self.root}/{log}/table_name={quote(entry[0], safe='')}/entry={uuid.uuid4().hex}"
        self.spark.createDataFrame([entry], schema).drop("table_name").coalesce(1).write.parquet(folder)

    def _log(self, log: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{log}").select(*schema.names)

    def versions(self) -> DataFrame:
        """One row per published version of every table."""
        return self._log("_versions", VERSIONS)

    def events(self) -> DataFrame:
        """One row per file load: rows and milliseconds of its phases as JSON ``detail``."""
        return self._log("_events", EVENTS)

    def sources(self) -> DataFrame:
        """One row per refresh of a source: status, high-water mark, rows of the table, error."""
        return self._log("_sources", SOURCES)

    def files(self) -> DataFrame:
        """Size, digest and load of every file that was loaded into a table, and the run that brought it."""
        loads = self.versions().select("table_name", "load_id").distinct()
        return self._log("_files", FILES).dropDuplicates(["table_name", "file", "load_id"]).join(loads, ["table_name", "load_id"], "left_semi")

    def log_event(self, table: str, load_id: str, detail: dict) -> None:
        self._append("_events", (table, load_id, json.dumps(detail), _now()), EVENTS)

    def log_refresh(self, table: str, load_id: str, status: str, watermark=None, row_count=None, error=None) -> None:
        mark = None if watermark is None else str(watermark)
        self._append("_sources", (table, load_id, status, mark, row_count, error, _now()), SOURCES)

    def log_file(self, table: str, run_id: str, file: Row) -> None:
        """Note that a file, as ``new_files`` describes it, is about to be loaded; ``files`` shows it once that load is recorded."""
        self._append("_files", (table, run_id, *[file[f.name] for f in FILES.fields[2:]]), FILES)

    def new_files(self, table: str, files: DataFrame) -> DataFrame:
        """Of files, as ``delimited.file_digests`` describes them, one of each content that no load has brought to the table, with
        the load id that this content has.

        The record of versions itself says what was brought, so that nothing lies between a load and its note; a drop forgets it.
        """
        same = [f.name for f in FILES.fields[3:-1]]
        texts = files.select("file", *[F.col(c).cast(FILES[c].dataType).alias(c) for c in same])
        firsts = texts.groupBy(*same).agg(F.min("file").alias("file"))
        firsts = firsts.withColumn("load_id", F.concat(F.lit("file-"), F.md5(F.concat_ws("|", *same))))
        own = self.versions().where(F.col("table_name") == table)
        dropped = own.where(F.col("mode") == DROPPED).agg(F.coalesce(F.max("version"), F.lit(0)).alias("n")).first()["n"]
        return keep_by_key(firsts, own.where(F.col("version") > dropped), ["load_id"], present=False).select("file", *same, "load_id")

    def watermark(self, table: str) -> str | None:
        """The mark that the last successful refresh of a source stored."""
        done = self.sources().where((F.col("table_name") == table) & (F.col("status") == "completed"))
        return done.agg(F.max_by("watermark", "logged_at").alias("mark")).first()["mark"]

    def _state(self, table: str, load_id: str | None = None) -> State:
        """The newest version of a table, and whether a load id is recorded for it, in one look at the record."""
        own = self.versions().where(F.col("table_name") == table)
        found = own.agg(
            F.max_by(F.struct("version", "paths", "mode", "row_count", "schema_json"), "version").alias("newest"),
            F.coalesce(F.max(F.col("load_id") == F.lit(load_id)), F.lit(False)).alias("done"),
        ).first()
        newest = found.newest
        gone = newest is None or newest["mode"] == DROPPED
        return State(0 if newest is None else newest["version"], None if gone else newest, found.done and not gone)

    def _open(self, newest) -> DataFrame:
        return self._read(newest.paths, T.StructType.fromJson(json.loads(newest.schema_json)))

    def exists(self, table: str) -> bool:
        return self._state(table).newest is not None

    def read(self, table: str) -> DataFrame:
        """The current version."""
        newest = self._state(table).newest
        if newest is None:
            raise KeyError(table)
        return self._open(newest)

    def publish(
        self,
        table: str,
        rows: DataFrame,
        mode: str,
        load_id: str,
        inserted: int | None = None,
        kept: Kept = Kept([], 0),
        state=None,
    ) -> DataFrame:
        """Write a folder, compare what was sent with what its files hold, and make it and ``kept`` the next version.

        A load id that is recorded already is not written again; leftovers of an unrecorded attempt are overwritten.
        ``inserted`` of the written rows come from the load's file (all, when not given); rows of the version before
        that are in the next one neither way count as updated.  ``state`` is what the rows were made from, when they
        were made from the table; the next version follows that one or is refused.
        """
        state = self._state(table, load_id) if state is None else state
        if state.done:
            return self._open(state.newest)
        path = f"{self.root}/{table}/{load_id}"
        sent = Observation()
        with short_methods(self.spark):  # the rows are converted while they are written
            rows.observe(sent, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        held = self._read([path], rows.schema).count()  # from the file footers
        if held != sent.get["n"]:
            raise IntegrityError(f"{table}: {sent.get['n']} rows sent, {held} rows held; version not published")
        fresh = held if inserted is None else inserted
        paths = [*kept.paths, path]
        return self._record(state, table, load_id, mode, paths, kept.rows + held, fresh, rows.schema)

    def _record(
        self, state, table: str, load_id: str, mode: str, paths: list[str], row_count: int, fresh: int, schema: T.StructType
    ) -> DataFrame:
        """Make a list of files the current version."""
        before = state.newest
        version = state.version + 1
        self._claim(table, version, load_id)
        entry = (
            table,
            version,
            load_id,
            paths,
            mode,
            row_count,
            fresh,
            0 if before is None or mode in WHOLE_MODES else before.row_count - (row_count - fresh),
            schema.json(),
            _now(),
        )
        self._append("_versions", entry, VERSIONS)
        return self._read(paths, schema)

    def _claim(self, table: str, version: int, load_id: str) -> None:
        """Take a version's number: of two loads from one version one is refused.

        A load that died between this and its record keeps the number, and its retry, which has its id, goes on.
        """
        owner = self.owner(f"{self.root}/_claims/{quote(table, safe='')}/{version}", load_id)
        if owner != load_id:
            raise OvertakenError(f"{table}: version {version} is that of load {owner!r}")

    def _created(self, path: str, load_id: str) -> str:
        """The load in a file that the first caller wrote.  It is created whole or not at all, as Spark's streams commit batches:
        ``spark.sql.streaming.checkpointFileManagerClass`` names the class that does so on an object store."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        streaming = jvm.org.apache.spark.sql.execution.streaming.checkpointing
        path = jvm.org.apache.hadoop.fs.Path(path)
        manager = getattr(getattr(streaming, "CheckpointFileManager$"), "MODULE$").create(path.getParent(), conf)
        manager.mkdirs(path.getParent())
        try:
            out = manager.createAtomic(path, False)
            out.write(bytearray(load_id.encode("utf-8")))
            out.close()
        except Py4JJavaError as error:
            if not error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
        held = manager.open(path)
        owner = bytes(held.readAllBytes()).decode("utf-8")
        held.close()
        return owner

    def _read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def _split(self, newest, leaving: DataFrame) -> tuple[DataFrame | None, Kept]:
        """The rows of the files that hold a leaving row, and the files that hold none.

        ``leaving`` is a selection from the current version with its ``file_name``.  The driver sees file names, as it
        does whenever Spark lists a table.
        """
        target = self._open(newest)
        touched = {r.file_name for r in leaving.select("file_name").distinct().collect()}
        files = [unquote(f) for f in target.inputFiles()]
        rewritten = [f for f in files if f.rsplit("/", 1)[1] in touched]
        if not rewritten:
            return None, Kept(newest.paths, newest.row_count)
        rows = self._read(rewritten, target.schema)
        if len(rewritten) == len(files):
            return rows, Kept([], 0)
        untouched = [f for f in files if f.rsplit("/", 1)[1] not in touched]
        return rows, Kept(untouched, newest.row_count - rows.count())  # counted from the file footers

    def load(
        self, table: str, raw: DataFrame, mapping: list[ColumnSpec], mode: str, load_id: str, key: str | None = None
    ) -> DataFrame:
        """Load a text DataFrame in one of the modes ``replace``, ``append`` and ``upsert``.

        A replace of a table that has row hashes and the same columns becomes a delta replace.  A load that another one
        overtakes starts again from the new version.
        """
        return self._again(lambda: self._load(table, raw, mapping, mode, load_id, key))

    def _load(
        self, table: str, raw: DataFrame, mapping: list[ColumnSpec], mode: str, load_id: str, key: str | None
    ) -> DataFrame:
        state = self._state(table, load_id)
        if state.done:
            return self._open(state.newest)
        incoming = apply_mapping(raw, mapping, with_hash=True)
        newest = state.newest
        if newest is None:
            return self.publish(table, incoming, "replace", load_id, state=state)
        target = self._open(newest)
        mismatches = load.schema_mismatches(target, mapping)
        if mode == "replace":
            if mismatches or ROW_HASH not in target.columns:
                return self.publish(table, incoming, "replace", load_id, state=state)
            with materialized(incoming, "incoming") as file:  # parsed and hashed once, read by both joins
                with materialized(load.delta_changes(target, file), "changes") as changes:
                    return self._delta(state, table, file, changes, load_id)
        if mismatches:
            raise ValueError("incompatible schema: " + "; ".join(mismatches))
        if mode == "append":
            kept = Kept(newest.paths, newest.row_count)
            return self.publish(table, incoming, "append", load_id, kept=kept, state=state)
        if mode != "upsert":
            raise ValueError(f"unknown load mode {mode!r}")
        if key is None or key not in [c.sql_name for c in mapping]:
            raise ValueError("upsert needs a key column of the file")
        with materialized(incoming, "incoming") as file:
            return self.upsert(table, file, key, load_id)

    def _delta(self, state, table: str, incoming: DataFrame, changes: DataFrame, load_id: str) -> DataFrame:
        """Publish what a change set says: its new rows, and the files it takes rows out of without these."""
        target = self._open(state.newest)
        inserted = load.delta_counts(target, changes).first().inserted
        located = target.withColumn("file_name", F.col("_metadata.file_name"))
        unhashed = located.where(F.col(ROW_HASH).isNull())
        gone = changes.where("target_rows > 0")
        leaving = keep_by_key(located, gone, [ROW_HASH], present=True, unique=True).unionByName(unhashed)
        rows, kept = self._split(state.newest, leaving)
        if rows is None and inserted == 0:  # the same file again
            return self._record(state, table, load_id, "delta-replace", kept.paths, kept.rows, 0, target.schema)
        added = load.new_rows(incoming, changes)
        if rows is not None:
            added = load.rows_kept(rows, changes).unionByName(added)
        return self.publish(table, added, "delta-replace", load_id, inserted, kept, state)

    def upsert(self, table: str, incoming: DataFrame, key: str, load_id: str) -> DataFrame:
        """Publish ``incoming`` over the rows that share its keys.  Repeated keys are refused; a table that does not exist is made
        of ``incoming``.  An upsert that another load overtakes starts again from the new version."""
        if not load.duplicate_keys(incoming, key).isEmpty():
            raise ValueError(f"repeated keys in {key!r}")
        return self._again(lambda: self._upsert(table, incoming, key, load_id))

    def _again(self, work):
        for _ in range(ATTEMPTS - 1):
            try:
                return work()
            except OvertakenError:
                continue
        return work()

    def _upsert(self, table: str, incoming: DataFrame, key: str, load_id: str) -> DataFrame:
        state = self._state(table, load_id)
        if state.done:
            return self._open(state.newest)
        newest = state.newest
        if newest is None:
            return self.publish(table, incoming, "replace", load_id, state=state)
        target = self._open(newest)
        have, comes = ({f.name: f.dataType for f in df.schema.fields if f.name != ROW_HASH} for df in (target, incoming))
        if have != comes:
            odd = sorted(name for name in have.keys() | comes.keys() if have.get(name) != comes.get(name))
            raise load.SchemaMismatch(f"{table}: columns differ from the table's: {', '.join(odd)}")
        rows, kept = None, Kept(newest.paths, newest.row_count)
        files = file_stats.admitting(self, table, target, incoming, key)
        if files:
            located = self._read(files, target.schema).withColumn("file_name", F.col("_metadata.file_name"))
            rows, kept = self._split(newest, keep_by_key(located, incoming, [key], present=True))
        new = incoming if rows is None else load.upsert(rows, incoming, key)
        return self.publish(table, new, "upsert", load_id, incoming.count(), kept, state)

    def compact(self, table: str, load_id: str, file_bytes: int = FILE_BYTES) -> DataFrame:
        """Publish the same rows in files of about one size: appends and deltas add a folder each."""
        return self._again(lambda: self._compact(table, load_id, file_bytes))

    def _compact(self, table: str, load_id: str, file_bytes: int) -> DataFrame:
        state = self._state(table, load_id)
        rows = self._open(state.newest)
        files = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).distinct()
        size = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
        return self.publish(table, rows.repartition(max(1, -(-size // file_bytes))), "compact", load_id, 0, state=state)

    def drop(self, tables: list[str], load_id: str) -> None:
        """Record that tables are gone.  ``vacuum`` then deletes their files; a later load starts them anew."""
        for table in tables:
            state = self._state(table)
            if state.newest is not None:
                self._claim(table, state.version + 1, load_id)
                entry = (table, state.version + 1, load_id, [], DROPPED, 0, 0, 0, state.newest["schema_json"], _now())
                self._append("_versions", entry, VERSIONS)

    def vacuum(self, table: str, keep: int = 1) -> list[str]:
        """Delete the folders that recorded loads wrote and none of the last ``keep`` versions lists; returns them.

        Folders of loads that are not recorded yet are left alone: they may be at work.
        """
        own = self.versions().where(F.col("table_name") == table)
        listed = own.orderBy(F.desc("version")).limit(keep).select(F.explode("paths").alias("path"))
        folder = F.concat(F.lit(f"{self.root}/{table}/"), F.col("load_id"))
        # a path is a folder, or a file of one that was kept when its neighbours were rewritten
        used = listed.select(F.substring_index(F.regexp_replace("path", "/part-[^/]*$", ""), "/", -1).alias("load_id"))
        gone = own.select("load_id").distinct().join(used.distinct(), "load_id", "left_anti").select(folder.alias("folder"))
        deleted = []
        for row in gone.collect():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(row["folder"])
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True):
                deleted.append(row["folder"])
        return deleted
