"""The document store: entries as Parquet snapshots behind a pointer.

A change writes new folders and then a new numbered pointer that names all folders of the new state. A pointer is never replaced or
removed by a change, so that readers see the old or the new state at any moment, and a lost executor or driver
leaves the store as it was. Of two writers that start from one pointer the second finds its number taken and
begins anew on the first one's state, so no change is lost. Entries lie in parts by the hash of their source: deleting or refreshing a source rewrites its
part only. JSON is for import and export.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as X
from docmill.schema import CONTENT_TYPES, ENTRY

VERSION = 1
#: Pointers are numbered; the one with the greatest number counts.
POINTER = "CURRENT.{:012d}.json"
#: Parts by source that a folder of entries has.
PARTS = 16
#: Attempts of a change that meets other writers.
ATTEMPTS = 20
#: Rows up to which entries are exported as one JSON document.
SINGLE_FILE_ROWS = 100_000

_TIME = T.StructType([T.StructField("secs_since_epoch", T.LongType()), T.StructField("nanos_since_epoch", T.LongType())])


@dataclass(frozen=True)
class StoreMetadata:
    version: int
    created_at: str
    last_modified: str
    document_count: int
    folders: tuple[str, ...] = ()
    number: int = 0


class Conflict(RuntimeError):
    """Another writer has moved the pointer."""


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class _Files:
    """The few file operations of the pointer, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._jvm, self._root = jvm, jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._root)] if self._fs.exists(self._root) else []

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write(self, name: str, text: str) -> None:
        """A file of a new name or over an old one, whole or not at all."""
        self._fs.mkdirs(self._root)
        staged = f".{name}.{uuid.uuid4().hex}"
        self._put(staged, text)
        if not self._fs.rename(self._at(staged), self._at(name)):
            self._fs.delete(self._at(name), False)
            if not self._fs.rename(self._at(staged), self._at(name)):
                raise OSError(f"can't write {name} in {self._root}")

    def write_new(self, name: str, text: str) -> None:
        """A file that mustn't be there: whoever creates its claim first writes it."""
        self._fs.mkdirs(self._root)
        try:
            self._fs.create(self._at(f".{name}.claim"), False).close()
        except Exception as e:
            raise Conflict(name) from e
        staged = f".{name}.{uuid.uuid4().hex}"
        self._put(staged, text)
        if not self._fs.rename(self._at(staged), self._at(name)):
            raise OSError(f"can't write {name} in {self._root}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def part_of_source(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(PARTS)).cast("int")


def part_number(spark: SparkSession, source: str) -> int:
    return spark.range(1).select(part_of_source(F.lit(source))).first()[0]


class Store:
    """Entries under ``path``. Nothing is cached: each read starts from the pointer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = _Files(spark, self.path)

    def metadata(self) -> StoreMetadata | None:
        """None if there is no store yet; an error for one of another version."""
        pointers = sorted(n for n in self._files.names() if n.startswith("CURRENT.") and n.endswith(".json"))
        if not pointers:
            return None
        d = json.loads(self._files.read(pointers[-1]))
        if d.get("version") != VERSION:
            raise ValueError(f"store of version {d.get('version')}, expected {VERSION}")
        return StoreMetadata(**{**d, "folders": tuple(d["folders"])})

    def create(self) -> StoreMetadata:
        """An empty store, unless there is one."""
        return self._change(lambda m: m) if self.metadata() is None else self.metadata()

    def _change(self, change: Callable[[StoreMetadata], StoreMetadata]) -> StoreMetadata:
        """Move the pointer to ``change`` of the state; computed anew where another writer was first."""
        for attempt in range(ATTEMPTS):
            m = self.metadata() or StoreMetadata(VERSION, _now(), _now(), 0)
            new = change(m)
            new = replace(new, last_modified=_now(), number=m.number + 1)
            try:
                self._files.write_new(POINTER.format(new.number), json.dumps(asdict(new)))
                return new
            except Conflict:
                time.sleep(0.1 * (attempt + 1))
        raise Conflict(f"{self.path}: other writers were first {ATTEMPTS} times")

    def entries(self) -> DataFrame:
        """All entries; none if there is no store."""
        m = self.metadata()
        if not m or not m.folders:
            return self.spark.createDataFrame([], ENTRY)
        return self._read(m.folders)

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*(f"{self.path}/{f}" for f in folders))

    def documents(self) -> DataFrame:
        """Entries with the fields of their documents side by side."""
        d, m = F.col("document"), F.col("document.metadata")
        fields = [d[c].alias(c) for c in ("content", "url", "title", "section")] + [m[c].alias(c) for c in ("content_type", "language", "last_updated", "tags")]
        return self.entries().select("id", "indexed_at", "vector", *fields)

    def count(self) -> int:
        m = self.metadata()
        return m.document_count if m else 0

    def _write(self, df: DataFrame) -> list[str]:
        """The entries in a new folder, in parts by source; the folders of its parts."""
        folder = f"part-{uuid.uuid4().hex}"
        kind = F.col("document.metadata.content_type")
        known = F.when(kind.isNull() | kind.isin(*CONTENT_TYPES), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no such kind of document: "), kind)))
        rows = df.select(*(F.col(f.name).cast(f.dataType) for f in ENTRY)).withColumn("id", known)
        rows.withColumn("p", part_of_source(X.source_of(F.col("document.url")))).write.partitionBy("p").parquet(f"{self.path}/{folder}")
        return sorted(f"{folder}/{n}" for n in _Files(self.spark, f"{self.path}/{folder}").names() if n.startswith("p="))

    def _count(self, folders: Sequence[str]) -> int:
        return self._read(folders).count() if folders else 0

    def append(self, df: DataFrame) -> int:
        """Add entries (no check of ids, as many with one id as come); returns how many."""
        folders = self._write(df)
        n = self._count(folders)
        self._change(lambda m: replace(m, document_count=m.document_count + n, folders=(*m.folders, *folders)))
        return n

    def rewrite(self, change: Callable[[DataFrame], DataFrame], source: str | None = None) -> int:
        """Replace the entries by ``change`` of them (given as :meth:`entries` are); returns by how many fewer there are.

        With a ``source``, the change is one of that source's entries only, and only its part is read and written.
        Old folders stay until :meth:`vacuum`, for readers that began before.
        """
        before: list[int] = []

        def changed(m: StoreMetadata) -> StoreMetadata:
            touched = [f for f in m.folders if source is None or f.endswith(f"/p={part_number(self.spark, source)}")]
            old = self._read(touched) if touched else self.spark.createDataFrame([], ENTRY)
            folders = self._write(change(old))
            n = m.document_count - self._count(touched) + self._count(folders)
            before[:] = [m.document_count - n]
            return replace(m, document_count=n, folders=(*(f for f in m.folders if f not in touched), *folders))

        self._change(changed)
        return before[0]

    def remove(self, value: str) -> int:
        """Take out the entries of an id; returns how many. Folders without it stay as they are."""
        gone: list[int] = []

        def changed(m: StoreMetadata) -> StoreMetadata:
            held = self._read(m.folders).filter(F.col("id") == value).select(F.input_file_name().alias("f")).groupBy("f").count().collect() if m.folders else []
            touched = [f for f in m.folders if any(f"/{f}/" in r.f for r in held)]
            folders = self._write(self._read(touched).filter(F.col("id").isNull() | (F.col("id") != value))) if touched else []
            gone[:] = [sum(r["count"] for r in held)]
            return replace(m, document_count=m.document_count - gone[0], folders=(*(f for f in m.folders if f not in touched), *folders))

        self._change(changed)
        return gone[0]

    def clear(self) -> int:
        n = self.count()
        self._change(lambda m: replace(m, document_count=0, folders=()))
        return n

    def compact(self) -> None:
        """One snapshot instead of many appended ones."""
        self.rewrite(lambda df: df)

    def vacuum(self) -> int:
        """Remove the folders that the pointer doesn't name; returns how many."""
        m, named = self.create(), self._files.names()
        live = {f.split("/")[0] for f in m.folders}
        old = [n for n in named if n.startswith("part-") and n not in live]
        # pointers before the one that counts, but not the claims of the last ones, whose writers may be at work
        past = [n for n in named if n.lstrip(".").startswith("CURRENT.") and n.lstrip(".").split(".")[1].isdigit() and int(n.lstrip(".").split(".")[1]) < m.number]
        for name in (*old, *past):
            self._files.remove(name)
        return len(old)

    # JSON

    def import_json(self, path: str) -> int:
        """Append the entries of a JSON document {metadata, entries}; a missing file adds none, another version is an error."""
        found = read_json(self.spark, path)
        return 0 if found is None else self.append(found)

    def export_json(self, path: str) -> None:
        """One document if it has up to SINGLE_FILE_ROWS entries, else a folder of one entry a line."""
        write_json(self.entries(), path, self.create())


def _json_schema() -> T.StructType:
    meta = T.StructType([T.StructField("content_type", T.StringType()), T.StructField("language", T.StringType()), T.StructField("last_updated", _TIME), T.StructField("tags", T.ArrayType(T.StringType()))])
    doc = T.StructType([*(T.StructField(c, T.StringType()) for c in ("id", "content", "url", "title", "section")), T.StructField("metadata", meta)])
    vector = T.StructType([T.StructField("values", T.ArrayType(T.FloatType()))])
    return T.StructType([T.StructField("id", T.StringType()), T.StructField("document", doc), T.StructField("vector", vector), T.StructField("indexed_at", _TIME)])


def _to_time(c):
    return F.timestamp_micros(c["secs_since_epoch"] * 1_000_000 + F.floor(c["nanos_since_epoch"] / 1000))


def _from_time(c):
    micros = F.unix_micros(c)
    return F.when(c.isNotNull(), F.struct(F.floor(micros / 1_000_000).alias("secs_since_epoch"), (F.pmod(micros, F.lit(1_000_000)) * 1000).alias("nanos_since_epoch")))


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """Entries of a JSON document; None if there is no file."""
    if not _Files(spark, path)._fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return None
    entry = _json_schema()
    root = T.StructType([T.StructField("metadata", T.StructType([T.StructField("version", T.IntegerType())])), T.StructField("entries", T.ArrayType(entry))])
    data = spark.read.schema(root).option("multiLine", True).json(path)
    versions = [r.v for r in data.select(F.col("metadata.version").alias("v")).distinct().collect()]
    if any(v != VERSION for v in versions):
        raise ValueError(f"JSON of version {versions}, expected {VERSION}")
    e = data.select(F.explode("entries").alias("e")).select("e.*")
    m = F.col("document.metadata")
    meta = F.struct(m["content_type"].alias("content_type"), m["language"].alias("language"), _to_time(m["last_updated"]).alias("last_updated"), m["tags"].alias("tags"))
    doc = F.struct(*(F.col(f"document.{c}").alias(c) for c in ("id", "content", "url", "title", "section")), meta.alias("metadata"))
    return e.select("id", _to_time(F.col("indexed_at")).alias("indexed_at"), F.col("vector.values").alias("vector"), doc.alias("document"))


def json_entries(df: DataFrame) -> DataFrame:
    """Entries in the JSON document's form."""
    m = F.col("document.metadata")
    meta = F.struct(m["content_type"].alias("content_type"), m["language"].alias("language"), _from_time(m["last_updated"]).alias("last_updated"), m["tags"].alias("tags"))
    doc = F.struct(*(F.col(f"document.{c}").alias(c) for c in ("id", "content", "url", "title", "section")), meta.alias("metadata"))
    return df.select("id", doc.alias("document"), F.struct(F.col("vector").alias("values")).alias("vector"), _from_time(F.col("indexed_at")).alias("indexed_at"))


def write_json(df: DataFrame, path: str, metadata: StoreMetadata) -> None:
    rows = json_entries(df)
    if metadata.document_count > SINGLE_FILE_ROWS:
        rows.write.mode("overwrite").json(path)
        return
    lines = [r[0] for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]  # bounded by SINGLE_FILE_ROWS
    head = {"version": metadata.version, "created_at": metadata.created_at, "last_modified": metadata.last_modified, "document_count": metadata.document_count}
    folder, _, name = path.rpartition("/")
    _Files(df.sparkSession, folder or ".").write(name, json.dumps({"metadata": head})[:-1] + ', "entries": [' + ",\n".join(lines) + "]}")
