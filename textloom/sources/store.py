"""Collections as logs of versions: keyed rows in hash buckets, changed by whole commits.

Below a collection's folder, `data/<commit>/_bucket=<n>` holds rows and
`_log/<version>.json` says which of these folders make up a version.  A commit
writes the buckets that it touches beside the old ones and then publishes its
log file, which no other writer can have published before; what a writer leaves
behind without that is in no version, and `clear` removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

#: Buckets of a new collection, and how often a commit that meets others is tried.
BUCKETS, TRIES = 64, 50


@dataclass(frozen=True)
class Version:
    """What a version consists of: folders by bucket, the last batch of each stream, and the bytes that its commit wrote."""

    number: int
    commit: str
    key: str
    buckets: int
    schema: T.StructType
    files: dict[int, tuple[str, ...]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    written: int = 0

    def json(self) -> str:
        return json.dumps({"number": self.number, "commit": self.commit, "key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(), "files": self.files, "batches": self.batches, "written": self.written})

    @staticmethod
    def of(text: str) -> Version:
        held = json.loads(text)
        files = {int(b): tuple(f) for b, f in held["files"].items()}
        return Version(**(held | {"schema": T.StructType.fromJson(held["schema"]), "files": files}))


def merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both; a column has one type."""
    types = {f.name: f.dataType for f in old}
    for f in new:
        if types.setdefault(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


class Log:
    """Numbered texts below `path`, each published once: the states of what lies beside them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop.Path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the published versions, old to new."""
        return [int(n[:-5]) for n in self._names("_log") if n.endswith(".json") and not n.startswith(".")]

    def text(self, number: int) -> str:
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/_log/{number:020d}.json"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, number: int, commit: str, text: str) -> bool:
        """Publishes `text` under a number; False if another writer has done so."""
        folder = f"{self.path}/_log"
        target = self._hadoop.Path(f"{folder}/{number:020d}.json")
        own = self._hadoop.Path(f"{folder}/.{commit}.tmp")
        out = self._fs.create(own, True)
        out.write(text.encode())
        out.close()
        try:
            if self._fs.getScheme() == "file":  # there a rename replaces what is there; a hard link doesn't
                java = self.spark._jvm.java
                place = lambda p: java.nio.file.Paths.get(p.toUri().getPath(), self.spark._sc._gateway.new_array(java.lang.String, 0))
                java.nio.file.Files.createLink(place(target), place(own))
            else:
                context = self._hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(self._fs.makeQualified(own), self._fs.makeQualified(target), self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        finally:
            self._fs.delete(own, False)
        return True

    def drop(self) -> bool:
        """Removes all versions and what lies beside them; whether there was anything."""
        return self._fs.delete(self._hadoop.Path(self.path), True)


class Collection(Log):
    """The collection `name` below `root`, a folder of any file system that Spark reads; a null key is a key like others."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        if not name or "/" in name or name in (".", ".."):
            raise ValueError("not the name of a collection")
        super().__init__(spark, f"{root.rstrip('/')}/{name}")

    def version(self, number: int | None = None) -> Version | None:
        """A published version, the newest by default; None for a collection that doesn't exist."""
        if number is None:
            numbers = self.versions()
            if not numbers:
                return None
            number = numbers[-1]
        return Version.of(self.text(number))

    def scan(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version; they stay readable until `clear` removes the version."""
        held = self.version(number)
        return None if held is None else self._rows(held, held.files)

    def _rows(self, held: Version, buckets: Iterable[int]) -> DataFrame:
        paths = [f"{self.path}/data/{f}/_bucket={b}" for b in buckets for f in held.files.get(b, ())]
        return self.spark.read.schema(held.schema).parquet(*paths) if paths else self.spark.createDataFrame([], held.schema)

    def _publish(self, new: Version) -> bool:
        return self.publish(new.number, new.commit, new.json())

    def _bucketed(self, rows: DataFrame, held: Version) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(held.key), F.lit(held.buckets)).cast("int"))

    def _write(self, rows: DataFrame, commit: str) -> tuple[set[int], int]:
        """Writes rows(..., _bucket) as folders of `commit`; the buckets that have rows, and bytes."""
        path = f"{self.path}/data/{commit}"
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        held = {int(n.split("=")[1]) for n in self._names(f"data/{commit}") if n.startswith("_bucket=")}
        return held, self._fs.getContentSummary(self._hadoop.Path(path)).getLength()

    def _new(self, key: str, buckets: int, schema: T.StructType) -> Version:
        if key not in schema.names:
            raise ValueError(f"rows need the column {key}")
        held = self.version()
        if held is None:
            return Version(0, "", key, buckets, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
        if held.key != key:
            raise ValueError(f"the collection's key is {held.key}")
        return held

    def _rewrite(self, touched: set[int], schema: T.StructType, change, key: str, buckets: int) -> Version:
        """Publishes change(rows of the touched buckets) in their place.

        Where another version has come up meanwhile, the buckets are written
        again only if that one has changed one of them.
        """
        base, ours = None, None
        for _ in range(TRIES):
            held = self._new(key, buckets, schema)
            if ours is None or any(held.files.get(b) != base.files.get(b) for b in touched):
                base, commit = held, uuid.uuid4().hex
                types = merged(held.schema, schema)
                full = replace(held, schema=types)
                ours = self._write(self._bucketed(change(self._rows(full, touched)), held).select(*types.names, "_bucket"), commit)
            files = held.files | {b: (commit,) if b in ours[0] else () for b in touched}
            new = replace(held, number=held.number + 1, commit=commit, schema=merged(held.schema, types), files=files, written=ours[1])
            if self._publish(new):
                return new
        raise RuntimeError(f"other writers have published {TRIES} versions meanwhile")

    def upsert(self, rows: DataFrame, key: str = "chunk_id", version: str | None = None, buckets: int = BUCKETS) -> Version:
        """Rows replace those of the same key; of repeated keys the one with the largest `version` stays (null first; any without that column).

        Only buckets with new rows are read and written.  Columns that old or
        new rows lack are null there.
        """
        held = self._new(key, buckets, rows.schema)
        rest = [c for c in rows.columns if c != key]
        order = F.struct(F.col(version).isNotNull(), F.col(version)) if version else F.lit(0)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*") if rest else rows.distinct()
        new = written(self._bucketed(last.select(*rows.columns), held), "upsert")
        touched = {r._bucket for r in new.select("_bucket").distinct().collect()}  # `buckets` numbers at most

        def change(old: DataFrame) -> DataFrame:
            fresh = new.drop("_bucket")
            kept = old.alias("o").join(fresh.select(F.col(key).alias("k")), same(F.col(f"o.{key}"), F.col("k")), "left_anti")
            return kept.unionByName(fresh, allowMissingColumns=True)

        return self._rewrite(touched, rows.schema, change, key, buckets)

    def delete(self, ids: DataFrame, key: str | None = None) -> int:
        """Removes the rows whose key is in `ids`; how many there were.  Only buckets that hold one are written."""
        held = self.version()
        if held is None:
            return 0
        wanted = ids.select(F.col(key or held.key).alias(held.key)).distinct()
        wanted = written(self._bucketed(wanted, held), "delete")
        near = {r._bucket for r in wanted.select("_bucket").distinct().collect()} & {b for b, f in held.files.items() if f}
        hit = self._bucketed(self._rows(held, near), held).join(wanted.select(F.col(held.key).alias("k")), same(F.col(held.key), F.col("k")), "left_semi").groupBy("_bucket").count().collect()
        if hit:
            anti = lambda old: old.join(wanted.select(F.col(held.key).alias("k")), same(F.col(held.key), F.col("k")), "left_anti")
            self._rewrite({r._bucket for r in hit}, held.schema, anti, held.key, held.buckets)
        return sum(r["count"] for r in hit)

    def append(self, rows: DataFrame, key: str = "chunk_id", stream: str | None = None, batch: int = 0, buckets: int = BUCKETS) -> Version:
        """Adds rows whose keys are new, without reading old ones; a batch of a stream that is in the collection already changes nothing."""
        commit, ours = uuid.uuid4().hex, None
        for _ in range(TRIES):
            held = self._new(key, buckets, rows.schema)
            if stream is not None and held.batches.get(stream, -1) >= batch:
                return held
            types = merged(held.schema, rows.schema)
            ours = ours or self._write(self._bucketed(rows, held), commit)
            files = held.files | {b: (*held.files.get(b, ()), commit) for b in ours[0]}
            new = replace(held, number=held.number + 1, commit=commit, schema=types, files=files, batches=held.batches | ({} if stream is None else {stream: batch}), written=ours[1])
            if self._publish(new):
                return new
        raise RuntimeError(f"other writers have published {TRIES} versions meanwhile")

    def compact(self, most: int = 8) -> Version | None:
        """Writes the buckets of more than `most` folders as one each."""
        held = self.version()
        crowded = {b for b, f in held.files.items() if len(f) > most} if held else set()
        return self._rewrite(crowded, held.schema, lambda old: old, held.key, held.buckets) if crowded else held

    def clear(self, keep: int = 1, older: float = 86_400.0) -> int:
        """Removes all but the last `keep` versions, and folders of `older` seconds or more that are in none of them, such as a dead writer's; how many."""
        numbers = self.versions()
        used = {(f, b) for n in numbers[-keep:] for b, fs in self.version(n).files.items() for f in fs}
        before, n = self.spark._jvm.java.lang.System.currentTimeMillis() - int(older * 1000), 0
        for number in numbers[:-keep]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/_log/{number:020d}.json"), False)
        for commit in self._names("data"):
            held = {int(b.split("=")[1]) for b in self._names(f"data/{commit}") if b.startswith("_bucket=")}
            gone = {b for b in held if (commit, b) not in used}
            if self._fs.getFileStatus(self._hadoop.Path(f"{self.path}/data/{commit}")).getModificationTime() > before or held and not gone:
                continue
            for folder in [f"data/{commit}"] if gone == held else [f"data/{commit}/_bucket={b}" for b in gone]:
                n += self._fs.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
        return n


def names(spark: SparkSession, root: str) -> list[str]:
    """The collections below `root` that have a version, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/_log/*.json")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted({f.getPath().getParent().getParent().getName() for f in found})
