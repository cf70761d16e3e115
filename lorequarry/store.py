"""Tables as appended parts, and a log of commits: a commit changes all its tables or none, and rewrites no old row."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from .errors import KnowledgeError
from .schema import FOLDERS, OWNED, SCHEMA_VERSION, SORTED, TABLES, shaped

#: Every so many versions the log has a full state too, and a reader takes the last one and the entries after it.
CHECKPOINT = 10
#: Times that a commit which doesn't hang on what was read is tried again after another one came in between.
TRIES = 5


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset, one in the warehouse of a local
    session, whose executors are the driver's threads; anywhere else that is an error, as no folder is known to be shared."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local["):
            raise KnowledgeError("E_IO", "spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return path.rstrip("/")


#: Bytes of the different values of a column that a file keeps once: postings name each chunk once for each of its terms.
DICTIONARY = 1 << 25


def packed(writer: DataFrameWriter) -> DataFrameWriter:
    return writer.option("compression", "zstd").option("parquet.dictionary.page.size", str(DICTIONARY))


#: So many hashes are broadcast to the stored ones.
MAX_NAMED = 1_000_000


def few(rows: DataFrame) -> DataFrame:
    """rows as a side to broadcast, if there are MAX_NAMED at most, so that what they are joined with isn't shuffled."""
    return F.broadcast(rows) if rows.limit(MAX_NAMED + 1).count() <= MAX_NAMED else rows


def applied(state: dict, change: dict) -> dict:
    """The state after an entry of the log."""
    tables = {**state["tables"], **{name: [] for name in change["replace"]}}
    for name, parts in change["add"].items():
        tables[name] = [*tables.get(name, []), *parts]
    deleted = [] if change.get("undeleted") else state["deleted"]
    forgotten = [] if "posting" in change["replace"] else state.get("forgotten", [])
    sums = {} if "chunk" in change["replace"] else state.get("stats", {})
    stats = {key: sums.get(key, 0) + change["stats"].get(key, 0) for key in ("chunks", "terms")}
    lists = {"deleted": [*deleted, *change.get("deleted", [])], "forgotten": [*forgotten, *change.get("forgotten", [])]}
    return {"version": change["version"], "schema": change["schema"], "at": change["at"], "tables": tables, **lists, "stats": stats}


class Store:
    """Parts under path, which may be in any store that Spark reads.

    A commit writes its new rows to tables/NAME/v=N/u=UNIQUE, and then log/N.json, which names just the parts that it adds,
    so an entry is as small after a million commits as after one. Every CHECKPOINT versions log/N.full.json has the whole
    state, which any reader could make again from the entries. The entry is made in one step that fails if it is there
    already (a link, or a rename that doesn't overwrite), so of several writers just one makes version N; what the others
    wrote is never read. Documents are deleted by a part of their ids: rows of such a document in older parts are left
    out when the table is read. compacted() writes what is left anew, and clean() removes what no state of the time of
    retention names. The entry holds the number of chunks and of their terms, and names parts of the numbers of terms
    that were deleted, so a keyword search needs no count over the tables.

    A store that is pinned to a version shows the tables as they were then, and can't be written to.
    """

    def __init__(self, spark: SparkSession, path: str, pinned: int | None = None):
        self.spark, self.path, self.pinned = spark, path.rstrip("/"), pinned
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _read(self, at) -> dict:
        stream = at.getFileSystem(self._conf).open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def versions(self) -> tuple[list[int], list[int]]:
        """The versions that the log has entries of, and those that it has the full state of."""
        log = self._at("log")
        fs = log.getFileSystem(self._conf)
        names = [x.getPath().getName() for x in fs.listStatus(log)] if fs.exists(log) else []
        whole = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        return sorted(int(n.removesuffix(".json")) for n in whole if ".full" not in n), sorted(int(n.removesuffix(".full.json")) for n in whole if ".full" in n)

    def pointer(self, version: int | None = None) -> dict:
        """{"version": n, "schema": s, "tables": {table: [part]}, "deleted": [part], "forgotten": [part], "stats": {...},
        "at": seconds} as of the last commit, or of that version; version 0 before the first."""
        version = self.pinned if version is None else version
        logged, full = self.versions()
        last = max(logged, default=0) if version is None else version
        if last and last not in logged:
            raise KnowledgeError("E_DB", f"no version {last}")
        if not last:
            return self._first_layout() or {"version": 0, "schema": SCHEMA_VERSION, "tables": {}, "deleted": [], "forgotten": [], "stats": {}}
        changes, state = [], None
        for v in reversed([v for v in logged if v <= last]):
            if v in full:
                state = self._read(self._at(f"log/{v:012d}.full.json"))
                break
            entry = self._read(self._at(f"log/{v:012d}.json"))
            if "tables" in entry:  # of a log in which each entry has the whole state
                state = entry
                break
            changes.append(entry)
        state = state or self._first_layout() or {"version": 0, "schema": SCHEMA_VERSION, "tables": {}, "deleted": [], "forgotten": [], "stats": {}}
        for entry in reversed(changes):
            state = applied(state, entry)
        return state

    def _first_layout(self) -> dict | None:
        """The pointer of a store of schema 1, whose commits wrote whole tables and replaced a file CURRENT."""
        at = self._at("CURRENT")
        if not at.getFileSystem(self._conf).exists(at):
            return None
        old = self._read(at)
        return {"version": old["version"], "schema": "1", "tables": {t: [f] for t, f in old["tables"].items()}, "deleted": []}

    def rows(self, name: str, state: dict | None = None) -> DataFrame:
        """All rows of a table that aren't deleted, and v, the version that each came with."""
        state = state or self.pointer()
        parts = state["tables"].get(name, [])
        if not parts:
            return self.spark.createDataFrame([], f"{TABLES[name]}, v long")
        if state["schema"] == "1":
            return shaped(self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts]), name).withColumn("v", F.lit(0).cast("long"))
        read = self._parts(parts, f"{self.path}/tables/{name}", TABLES[name])
        if name == "posting":
            read = read.select("term", "v", F.inline("postings")).select("term", "chunk_id", "document_id", "tf", "length", "v")
        return self.alive(read, name, state)

    def alive(self, rows: DataFrame, name: str, state: dict) -> DataFrame:
        """rows of a table, with v, without those of documents that were deleted after that version."""
        if name not in OWNED or not state["deleted"]:
            return rows
        gone = self._parts(state["deleted"], f"{self.path}/tables/_deleted", "document_id string")
        gone = gone.groupBy(F.col("document_id").alias("_id")).agg(F.max("v").alias("_v"))
        return rows.join(few(gone), (F.expr(OWNED[name]) == F.col("_id")) & (F.col("v") < F.col("_v")), "left_anti")

    def blocks(self, state: dict) -> DataFrame:
        """The blocks of postings as they are stored, with v; those of deleted documents among them."""
        parts = state["tables"].get("posting", [])
        if not parts:
            return self.spark.createDataFrame([], f"{TABLES['posting']}, v long")
        return self._parts(parts, f"{self.path}/tables/posting", TABLES["posting"])

    def edges(self, state: dict) -> DataFrame:
        """The table related_to with bucket, whose values are folders: that of an edge hangs on its source."""
        parts = state["tables"].get("related_to", [])
        column, rule = FOLDERS["related_to"]
        if not parts or state["schema"] == "1":
            return self.table("related_to", state).withColumn(column, F.expr(rule))
        return self._parts(parts, f"{self.path}/tables/related_to", f"{TABLES['related_to']}, {column} int").drop("v")

    def forgotten(self, state: dict) -> DataFrame:
        """(term, df): how many chunks with a term were deleted, in several rows."""
        if not state.get("forgotten"):
            return self.spark.createDataFrame([], "term string, df long")
        return self._parts(state["forgotten"], f"{self.path}/tables/_forgotten", "term string, df long").drop("v")

    def _parts(self, parts: list[str], base: str, schema: str) -> DataFrame:
        read = self.spark.read.schema(f"{schema}, v long, u string").option("basePath", base).parquet(*[f"{self.path}/{p}" for p in parts])
        return read.select(*[field.split(" ", 1)[0] for field in schema.split(", ")], "v")  # without folders that aren't asked for

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        """A table as it is now: an entity has its first name and kind and its last description, a key of meta its last value."""
        if name not in TABLES:
            raise KnowledgeError("E_DB", f"no table {name}")
        rows = self.rows(name, state)
        if name == "entity":
            merged = rows.groupBy("entity_id").agg(F.min_by(F.struct("name", "kind"), F.struct("v", "kind", "name")).alias("e"), F.max(F.when(F.col("description").isNotNull(), F.struct("v", "description"))).alias("d"))
            return merged.select("entity_id", "e.name", "e.kind", F.col("d.description").alias("description"))
        if name == "meta":
            return rows.groupBy("key").agg(F.max_by("meta_value", "v").alias("meta_value"))
        if name == "reach":
            return rows.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))
        return rows.drop("v")

    def tables(self, state: dict | None = None) -> dict[str, DataFrame]:
        state = state or self.pointer()
        return {name: self.table(name, state) for name in TABLES}

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, deleted: DataFrame | None = None, since: int | None = None, migrating: bool = False, forgotten: DataFrame | None = None, stats: dict | None = None, moved: dict[str, list[str]] | None = None, emptied: Sequence[str] = ()) -> int:
        """Appends rows to tables, replaces whole ones, and deletes documents (document_id) from all older parts.

        forgotten: (term, df) of what is deleted. stats: what is to be added to the numbers in the log; those of a commit
        that replaces chunks are the new numbers.

        moved: folders that hold rows of a table already, as write() would put them; they are moved, not copied, once all
        else is written, and back if the commit fails. This needs since. emptied: tables whose rows before the commit go.

        since: the version that what is written was made from; the commit fails if there is a later one. Without it the
        commit is made after whatever came in between. A commit that is migrating replaces all tables that there are.
        """
        if self.pinned is not None:
            raise KnowledgeError("E_DB", f"the store is shown as of version {self.pinned}, and can't be written to")
        for left in reversed(range(TRIES)):
            before = self.pointer()
            if since is not None and before["version"] != since:
                raise KnowledgeError("E_DB", f"version {since} was replaced by {before['version']}")
            if before["schema"] != SCHEMA_VERSION and before["version"] and not migrating:
                raise KnowledgeError("E_DB", f"the store has schema {before['schema']}; migrate it first")
            version = before["version"] + 1
            written = self._written(before, version, append or {}, replace or {}, deleted, forgotten, stats, moved, emptied)
            if self._logged(written):
                return version
            for folder, part in written["moved"]:
                self._move(f"{self.path}/{part}", folder)
            if since is not None or not left:
                raise KnowledgeError("E_DB", "another commit came in between")
        raise AssertionError

    def _written(self, before: dict, version: int, append: dict, replace: dict, deleted: DataFrame | None, forgotten: DataFrame | None = None, stats: dict | None = None, moved: dict[str, list[str]] | None = None, emptied: Sequence[str] = ()) -> dict:
        """The state after a commit, whose parts are written; "change" is its entry in the log."""
        own = f"v={version}/u={uuid.uuid4().hex}"
        jobs, add = [], {}
        for name, df in [*replace.items(), *append.items()]:
            jobs.append((self.write, shaped(df, name), name, own))
            add.setdefault(name, []).append(f"tables/{name}/{own}")
        change = {"version": version, "schema": SCHEMA_VERSION, "at": time.time(), "replace": [*replace, *emptied], "add": add, "stats": stats or {}}
        for kind, df in (("deleted", deleted and deleted.select("document_id").distinct()), ("forgotten", forgotten)):
            if df is not None:
                jobs.append((self._write, df, f"tables/_{kind}/{own}"))
                change[kind] = [f"tables/_{kind}/{own}"]
        with ThreadPoolExecutor(4) as pool:  # jobs of one commit, side by side
            for done in [pool.submit(*job) for job in jobs]:
                done.result()
        there = []
        for name, folders in (moved or {}).items():
            for folder in folders:
                part = f"tables/{name}/v={version}/u={uuid.uuid4().hex}"
                self._move(folder, f"{self.path}/{part}")
                there.append((folder, part))
                add.setdefault(name, []).append(part)
        return {**applied(before, change), "change": change, "moved": there}

    def _move(self, folder: str, to: str) -> None:
        at, new = self._hadoop.Path(folder), self._hadoop.Path(to)
        fs = at.getFileSystem(self._conf)
        fs.mkdirs(new.getParent())
        if not fs.rename(at, new):
            raise KnowledgeError("E_IO", f"{folder} can't be moved to {to}")

    def _write(self, df: DataFrame, part: str) -> None:
        packed(df.write).parquet(f"{self.path}/{part}")

    def write(self, df: DataFrame, name: str, part: str) -> None:
        """A part of a table: postings as they come, in segments; vectors in a folder for each cell."""
        if name in SORTED:
            # folders are dealt by ranges; in other files rows are in order, and what hash ids are in each is told by its pages
            df = (df.repartitionByRange(SORTED[name]) if name in FOLDERS else df).sortWithinPartitions(SORTED[name])
        if name in FOLDERS:
            column, rule = FOLDERS[name]
            if column not in df.columns:
                df = df.withColumn(column, F.expr(rule))
            if name not in SORTED:
                df = df.hint("rebalance", column)  # a large folder is dealt to several tasks
            packed(df.write.partitionBy(column)).parquet(f"{self.path}/tables/{name}/{part}")
        else:
            self._write(df, f"tables/{name}/{part}")

    def _logged(self, state: dict) -> bool:
        """Whether the entry was made; not, if there is one of that version. Then, at times, the full state."""
        if not self._made(f"log/{state['version']:012d}.json", state["change"]):
            return False
        if state["version"] % CHECKPOINT == 0:
            self._made(f"log/{state['version']:012d}.full.json", {k: v for k, v in state.items() if k not in ("change", "moved")})
        return True

    def _made(self, name: str, content: dict) -> bool:
        """Makes a file in one step; False, if it is there."""
        new, at = self._at(f"log/.{uuid.uuid4().hex}"), self._at(name)
        fs = at.getFileSystem(self._conf)
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        try:
            if fs.getScheme() == "file":  # a local rename would overwrite
                os.link(urlsplit(fs.makeQualified(new).toString()).path, urlsplit(fs.makeQualified(at).toString()).path)
                return True
            if fs.exists(at):
                return False
            return fs.rename(new, at)
        except FileExistsError:
            return False
        finally:
            fs.delete(new, False)

    def compacted(self, anew: dict[str, DataFrame] | None = None) -> int:
        """Every table written anew as one part without deleted rows; anew: what to write for some of them."""
        state = self.pointer()
        version = state["version"] + 1
        now = {name: self.table(name, state) for name, parts in state["tables"].items() if parts} | (anew or {})
        written = self._written(state, version, {}, now, None, stats=state["stats"])
        written["change"]["undeleted"], written["deleted"] = True, []
        if not self._logged(written):
            raise KnowledgeError("E_DB", "another commit came in between")
        return version

    def clean(self, retention: float = 7 * 86400.0) -> int:
        """Removes parts and working files that are older than `retention` seconds, and that neither the last state nor
        any state since then names; how many. Versions from before can't be shown any more."""
        limit, (logged, _) = time.time() - retention, self.versions()
        named, state = set(), None
        for v in reversed(logged):  # the last state, and those that were the last one at some time since the limit
            state = self.pointer(v)
            named |= {p for parts in state["tables"].values() for p in parts} | {*state["deleted"], *state.get("forgotten", [])}
            if state.get("at", 0) < limit:
                break
        removed = 0
        root = self._at("").getFileSystem(self._conf)
        base = root.makeQualified(self._at("")).toString().rstrip("/") + "/"
        for pattern in ("tables/*/v=*/u=*", "staged/*", "uploads/*", "reindex/*", "v=*/*"):
            for found in root.globStatus(self._at(pattern)) or []:
                part = found.getPath().toString().removeprefix(base)
                if part not in named and found.getModificationTime() < limit * 1000:
                    root.delete(found.getPath(), True)
                    removed += 1
        return removed

    def known(self, hashes: DataFrame, state: dict) -> DataFrame:
        """(sha256) of the stored documents with one of hashes (sha256); only the folders of their prefixes are read."""
        parts = state["tables"].get("document", [])
        if not parts or state["schema"] == "1":
            return self.table("document", state).select("sha256")
        column, rule = FOLDERS["document"]
        wanted = sorted(r[0] for r in hashes.select(F.expr(rule)).distinct().collect())  # 256 at most
        read = self._parts(parts, f"{self.path}/tables/document", f"document_id string, sha256 string, {column} string").where(F.col(column).isin(wanted))
        batch = hashes.select("sha256").distinct()
        return self.alive(read.join(few(batch), "sha256", "left_semi"), "document", state).select("sha256").distinct()

    def filed(self, state: dict, share: int, shares: int) -> DataFrame:
        """One of so many shares of the documents, each of which is some of their folders; only these are read."""
        parts = state["tables"].get("document", [])
        column, rule = FOLDERS["document"]
        if not parts or state["schema"] == "1":
            read = self.table("document", state).withColumn(column, F.expr(rule))
        else:
            read = self.alive(self._parts(parts, f"{self.path}/tables/document", f"{TABLES['document']}, {column} string"), "document", state).drop("v")
        return read.where(F.expr(f"pmod(xxhash64({column}), {shares}) = {share}")).drop(column)

    def finished(self, pattern: str) -> list[str]:
        """The folders of a pattern that a job has written to its end."""
        marks = self._at("").getFileSystem(self._conf).globStatus(self._at(f"{pattern}/_SUCCESS")) or []
        return sorted(found.getPath().getParent().toString() for found in marks)

    def scratch(self) -> str:
        """A folder for what one operation writes on its way; remove() it afterwards."""
        return f"{self.path}/staged/{uuid.uuid4().hex}"

    def remove(self, folder: str) -> None:
        at = self._hadoop.Path(folder)
        at.getFileSystem(self._conf).delete(at, True)

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["meta_value"] for r in self.table("meta").collect()}

    def meta_table(self, **values: str) -> DataFrame:
        """Rows of meta that set these values."""
        return self.spark.createDataFrame(sorted((k, str(v)) for k, v in values.items()), TABLES["meta"])
