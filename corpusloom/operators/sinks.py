"""Sinks for assets, parsed blocks and chunks: bucketed Parquet with a manifest written last.

A table is a folder. ``data/<id>/bucket=<b>`` holds rows whose hashed key falls into
bucket b; a manifest in ``versions`` names the data folders of each bucket that has
rows. A change rewrites only the buckets its keys fall into, under a new id, and then
writes the next manifest; rows with new keys are put beside those stored before. Readers take the newest whole manifest, so a writer that dies
earlier leaves the former version in place, and readers of an old version keep theirs
until ``expire``. One writer at a time.
"""

from __future__ import annotations

import copy
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import expr as X
from corpusloom.functions.scale import cut

BUCKETS = 256
#: Data folders that a bucket may have before it is written anew as one.
LAYERS = 8
MANIFEST = "bucket int, folder string"
CONTENTS, ASSETS = "content_hash string, content binary", "asset_id string, content_hash string, mime_type string, size long"
BLOCKS = "version_id string, ordinal int, kind string, text string, level int, page int"
DIGESTS = "version_id string, digest string, blocks long"


class Table:
    """One version of a stored table; ``key`` decides the bucket of a row and what a row replaces."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str, key: str, order: list[str] | None = None, buckets: int = BUCKETS
    ) -> None:
        self.spark, self.path, self.schema, self.key = spark, path, T.StructType.fromDDL(schema), key
        self.ddl, self.order, self.buckets = schema, order or [key], buckets
        # A manifest counts once its job has ended; of several with one number all readers take the same.
        names = [n for n in self._names("versions") if self._exists(f"{path}/versions/{n}/_SUCCESS")]
        newest = min(names, key=lambda n: (-int(n.split("-")[0]), n), default="0-")
        self.version, self.folders = int(newest.split("-")[0]), {}
        if names:
            rows = spark.read.schema(MANIFEST).parquet(f"{path}/versions/{newest}").collect()
            for r in rows:
                self.folders.setdefault(r.bucket, []).append(r.folder)

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        found, system = self._path(path)
        return system.exists(found)

    def _names(self, part: str) -> list[str]:
        """Names in a folder of the table, without marks and temporary files."""
        found, system = self._path(f"{self.path}/{part}")
        names = [s.getPath().getName() for s in system.listStatus(found)] if system.exists(found) else []
        return [n for n in names if n[0] not in "._"]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, buckets: list[int]) -> DataFrame:
        """Rows of some buckets: one scan per data folder, with the buckets as partition filter."""
        by_folder: dict[str, list[int]] = {}
        for b in buckets:
            for folder in self.folders.get(b, []):
                by_folder.setdefault(folder, []).append(b)
        full = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        parts = [
            self.spark.read.schema(full).parquet(f"{self.path}/data/{folder}").filter(F.col("bucket").isin(kept)).drop("bucket")
            for folder, kept in sorted(by_folder.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(sorted(self.folders))

    def find(self, keys: DataFrame) -> DataFrame:
        """Rows with one of the given keys; buckets without any are not read."""
        wanted = keys.select(F.col(self.key)).filter(F.col(self.key).isNotNull()).distinct()
        return self._read(self._touched(wanted)).join(wanted, self.key, "left_semi").select(self.schema.names)

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys: at most ``buckets`` numbers come to the driver. A null key is an error."""
        found = rows.select(F.col(self.key).isNull().alias("bad"), self.bucket(F.col(self.key)).alias("b")).distinct().collect()
        if any(r.bad for r in found):
            raise ValueError(f"rows without {self.key}")
        return sorted(r.b for r in found)

    def _rewrite(self, touched: list[int], rows: DataFrame) -> Table:
        """Store ``rows`` as the whole content of the touched buckets and commit."""
        made = self._write(rows)
        return self._commit({b: f for b, f in self.folders.items() if b not in set(touched)} | made)

    def _write(self, rows: DataFrame) -> dict[int, list[str]]:
        """A new data folder, named for each bucket that has rows in it."""
        folder = uuid.uuid4().hex
        known = F.coalesce(F.col(self.key), F.raise_error(F.lit(f"rows without {self.key}")).cast(self.schema[self.key].dataType))
        # Rebalancing gives each bucket its own files and splits a large one over several tasks.
        placed = rows.select(*self.schema.names).withColumn("bucket", self.bucket(known)).hint("rebalance", "bucket")
        placed.sortWithinPartitions("bucket", *self.order).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return {int(n.split("=")[1]): [folder] for n in self._names(f"data/{folder}")}

    def _commit(self, folders: dict[int, list[str]]) -> Table:
        made = self.spark.createDataFrame([(b, f) for b, fs in sorted(folders.items()) for f in fs], MANIFEST).coalesce(1)
        made.write.parquet(f"{self.path}/versions/{self.version + 1}-{uuid.uuid4().hex}")
        after = copy.copy(self)
        after.version, after.folders = self.version + 1, folders
        return after

    def insert(self, rows: DataFrame) -> Table:
        """Add rows whose keys are not stored; what a bucket holds is not read, but for one that has got too many folders."""
        made = self._write(rows)
        if not made:
            return self
        after = self._commit(self.folders | {b: self.folders.get(b, []) + f for b, f in made.items()})
        full = sorted(b for b in made if len(after.folders[b]) > LAYERS)
        return after._rewrite(full, after._read(full)) if full else after

    def upsert(self, rows: DataFrame, stored: bool = False) -> Table:
        """Rows replace all rows with their keys; a row without a key is an error.

        ``stored``: the rows come from a stored table and may be read several times.
        """
        ready = rows.select(*self.schema.names) if stored else cut(rows.select(*self.schema.names))
        touched = self._touched(ready)
        if not touched:
            return self
        old = self._read(touched).join(ready.select(self.key).distinct(), self.key, "left_anti")
        return self._rewrite(touched, old.select(self.schema.names).unionByName(ready))

    def delete(self, keys: DataFrame) -> Table:
        """Rows with these keys go; unknown keys change nothing."""
        gone = cut(self.find(keys).select(self.key).distinct())
        touched = self._touched(gone)
        return self._rewrite(touched, self._read(touched).join(gone, self.key, "left_anti")) if touched else self

    def expire(self) -> int:
        """Remove data folders that the newest version does not name, and older manifests; returns their number."""
        stale = [f"data/{n}" for n in self._names("data") if n not in {f for fs in self.folders.values() for f in fs}]
        stale += [f"versions/{n}" for n in self._names("versions") if int(n.split("-")[0]) < self.version]
        for name in stale:
            found, system = self._path(f"{self.path}/{name}")
            system.delete(found, True)
        return len(stale)


class AssetStore:
    """Contents by hash, and an index of assets whose ids are derived from the hash."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.index = Table(spark, f"{folder}/assets", ASSETS, "asset_id", buckets=buckets)
        self.contents = Table(spark, f"{folder}/contents", CONTENTS, "content_hash", buckets=buckets)

    def put(self, assets: DataFrame) -> DataFrame:
        """Store (content, mime_type); returns (asset_id, content_hash, outcome).

        Equal bytes are one asset with the least of their types; bytes stored already
        are not written again, even where only the index entry is missing. Null contents
        are left out. Contents are committed before the index that names them. ``assets``
        is read twice: hashes tell what is new, and only new bytes are written.
        """
        hashed = assets.filter("content is not null").withColumn("content_hash", F.sha2("content", 256))
        named = hashed.groupBy("content_hash").agg(F.min("mime_type").alias("mime_type"), F.max(F.length("content")).cast("long").alias("size"))
        ready = cut(named.withColumn("asset_id", X.uuid5(F.concat(F.lit("asset:"), "content_hash"))))
        known = self.contents.find(ready).select("content_hash")
        fresh = cut(ready.select("content_hash").join(known, "content_hash", "left_anti"))
        # Copies are combined before the exchange, which serves the join too.
        bytes_ = hashed.groupBy("content_hash").agg(F.any_value("content").alias("content"))
        self.contents = self.contents.insert(bytes_.join(fresh, "content_hash", "left_semi"))
        listed = cut(self.index.find(ready).select("asset_id", F.lit(True).alias("listed")))
        self.index = self.index.insert(ready.join(listed, "asset_id", "left_anti"))
        return ready.join(listed, "asset_id", "left").select(
            "asset_id", "content_hash", F.when(F.col("listed"), "known").otherwise("stored").alias("outcome"))

    def get(self, ids: DataFrame) -> DataFrame:
        """(asset_id, content_hash, content, outcome) of each asked id.

        ``outcome``: read, absent (no index entry), missing (an entry without bytes)
        or damaged (bytes that do not hash to their name, which are not returned).
        """
        asked = ids.select("asset_id").filter("asset_id is not null").distinct()
        entries = cut(self.index.find(asked).select("asset_id", "content_hash"))
        bytes_ = self.contents.find(entries).withColumn("whole", F.sha2("content", 256) == F.col("content_hash"))
        found = asked.join(entries, "asset_id", "left").join(bytes_, "content_hash", "left")
        outcome = (
            F.when(F.col("content_hash").isNull(), "absent").when(F.col("whole").isNull(), "missing")
            .when(F.col("whole"), "read").otherwise("damaged"))
        return found.select("asset_id", "content_hash", F.when(F.col("whole"), F.col("content")).alias("content"), outcome.alias("outcome"))

    def delete(self, ids: DataFrame) -> DataFrame:
        """Index entries go first, so a broken deletion leaves bytes without a name, never a name without bytes.

        Returns the deleted (asset_id, content_hash).
        """
        gone = cut(self.index.find(ids).select("asset_id", "content_hash"))
        self.index = self.index.delete(gone)
        self.contents = self.contents.delete(gone)
        return gone

    def contains(self, hashes: DataFrame) -> DataFrame:
        """The given content hashes that have bytes."""
        return self.contents.find(hashes).select("content_hash")


class BlockStore:
    """Parsed documents by version: blocks, and one digest per version that names what is stored."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.digests = Table(spark, f"{folder}/digests", DIGESTS, "version_id", buckets=buckets)
        self.blocks = Table(spark, f"{folder}/blocks", BLOCKS, "version_id", ["version_id", "ordinal"], buckets)

    @staticmethod
    def digest(blocks: DataFrame) -> DataFrame:
        """(version_id, digest, blocks, repeated): hash of the hashes of a version's blocks in order."""
        row = F.sha2(F.to_json(F.struct("ordinal", "kind", "text", "level", "page"), {"ignoreNullFields": "false"}), 256)
        marked = blocks.groupBy("version_id").agg(
            F.sort_array(F.collect_list(F.struct("ordinal", row.alias("h")))).alias("hs"), F.count_distinct("ordinal").alias("ordinals"))
        return marked.select(
            "version_id", F.sha2(F.array_join("hs.h", ""), 256).alias("digest"), F.size("hs").cast("long").alias("blocks"),
            (F.size("hs") > F.col("ordinals")).alias("repeated"))

    def put(self, blocks: DataFrame) -> DataFrame:
        """Store whole versions; returns (version_id, digest, outcome).

        ``outcome``: stored, known (same content before), conflict (other content
        before, which stays) or repeated (an ordinal occurs twice; refused). Blocks are
        committed before the digests, and blocks without a digest are written again.
        """
        rows = cut(blocks.filter("version_id is not null").select(*self.blocks.schema.names))
        offered = cut(self.digest(rows))
        stored = cut(self.digests.find(offered).select("version_id", F.col("digest").alias("before")))
        judged = offered.join(stored, "version_id", "left").withColumn(
            "outcome", F.when(F.col("repeated"), "repeated").when(F.col("before").isNull(), "stored")
            .when(F.col("before") == F.col("digest"), "known").otherwise("conflict"))
        fresh = judged.filter("outcome = 'stored'")
        self.blocks = self.blocks.upsert(rows.join(fresh.select("version_id"), "version_id", "left_semi"), stored=True)
        self.digests = self.digests.upsert(fresh, stored=True)
        return judged.select("version_id", "digest", "outcome")

    def scan(self, versions: DataFrame) -> DataFrame:
        """Blocks of the asked versions that are stored whole."""
        whole = self.digests.find(versions).select("version_id")
        return self.blocks.find(whole)


def put_chunks(table: Table, batch: DataFrame) -> tuple[Table, DataFrame]:
    """Upsert by chunk id; versions whose batch repeats an id are refused whole and returned."""
    ready = cut(batch)
    repeated = cut(ready.groupBy("version_id", "chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("version_id").distinct())
    return table.upsert(ready.join(repeated, "version_id", "left_anti"), stored=True), repeated
