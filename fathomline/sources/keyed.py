"""Tables that are replaced key by key, and a cache that only grows, as Parquet files and manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomline.functions.names import own_name
from fathomline.operators import lineage

#: Buckets of a table; a replacement rewrites those that hold one of its keys.
BUCKETS = 64


class KeyedTable:
    """A table of rows that are deleted and inserted by ``keys``, such as a company and a year.

    Rows are in buckets by a hash of their keys. A version of the table is a manifest: a small file that names a folder for
    each bucket. A change writes new folders for the buckets it touches, beside the old ones, and then a manifest, by
    renaming a file: readers see the version before or the one behind, never half of one. A run that fails, or loses
    its executors for good, leaves folders that no manifest names; :meth:`vacuum` deletes them. Of two writers that begin
    with the same version the second one to commit fails, and changes nothing. Null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The number of the last version; 0 before the first."""
        names = lineage.listed(self.spark, f"{self.path}/manifest")
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """schema (JSON, null before the first version), buckets (number by folder of ``data``) and column of the bucket."""
        at = self.version() if version is None else version
        return json.loads(lineage.read_file(self.spark, f"{self.path}/manifest/{at:08d}.json")) if at else {"schema": None, "column": None, "buckets": {}}

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        found = [f"{self.path}/data/{folder}/{manifest['column']}={b}" for b, folder in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing has been written to the table")
        return self._rows(manifest)

    def _commit(self, before: int, manifest: dict) -> int:
        if not lineage.write_new_file(self.spark, f"{self.path}/manifest/{before + 1:08d}.json", json.dumps(manifest)):
            raise RuntimeError(f"another writer has made version {before + 1}")
        return before + 1

    def change(self, df: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Puts ``combine(old, df)`` in the place of the rows in the buckets of ``df``'s keys; returns the new version.

        ``old`` are all rows of these buckets, and ``combine`` must keep those with keys that ``df`` has not. Both are
        in the schema of the table, columns of ``df`` that it has not are added to it as nulls.
        """
        before = self.version()
        manifest = self.manifest(before)
        column = manifest["column"] or own_name(df.columns, "bucket")
        rows = lineage.kept(df)
        touched = {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # as many as buckets at most
        if not touched:
            return before
        if manifest["schema"] is None:
            new = rows
        else:
            old = self._rows(manifest, touched)
            for f in rows.schema:
                if f.name not in old.columns:
                    old = old.withColumn(f.name, F.lit(None).cast(f.dataType))
            for f in old.schema:
                if f.name not in rows.columns:
                    rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
            new = combine(old, rows.select(*[F.col(f"`{c}`") for c in old.columns])).select(*[F.col(f"`{c}`") for c in old.columns])
        folder = uuid.uuid4().hex
        out = new.withColumn(column, self._bucket())
        out.repartition(F.col(f"`{column}`"), *[F.col(f"`{k}`") for k in self.keys]).write.partitionBy(column).parquet(f"{self.path}/data/{folder}")
        made = {n.split("=", 1)[1] for n in lineage.listed(self.spark, f"{self.path}/data/{folder}") if n.startswith(f"{column}=")}
        buckets = {b: f for b, f in manifest["buckets"].items() if int(b) not in touched} | dict.fromkeys(sorted(made), folder)
        return self._commit(before, {"schema": json.loads(new.schema.json()), "column": column, "buckets": buckets})

    def replace(self, df: DataFrame) -> int:
        """Deletes all rows that share their keys with a row of ``df`` and inserts those of ``df``; all others stay."""
        if self.version() == 0:
            return self.change(df, lambda old, new: new)

        def swapped(old: DataFrame, new: DataFrame) -> DataFrame:
            names = [own_name(old.columns, f"k{i}") for i in range(len(self.keys))]
            gone = new.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(self.keys, names, strict=True)]).distinct()
            same = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(self.keys, names, strict=True)]
            return old.join(gone, same, "left_anti").unionByName(new)

        return self.change(df, swapped)

    def upsert(self, df: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> int:
        """Puts ``merged(old and new rows)`` in place of what is there for the keys of ``df``, as :func:`store.last_wins` or another view of all rows of a key does."""
        return self.change(df, lambda old, new: merged(old.unionByName(new)))

    def vacuum(self, versions: int = 1) -> int:
        """Deletes what the last ``versions`` versions do not name; returns the number of folders that went. No writer may be at work."""
        last = self.version()
        keep = {f for v in range(max(1, last - versions + 1), last + 1) for f in self.manifest(v)["buckets"].values()}
        gone = [f for f in lineage.listed(self.spark, f"{self.path}/data") if f not in keep]
        for f in gone:
            lineage.removed(self.spark, f"{self.path}/data/{f}")
        return len(gone)


class VectorCache:
    """Vectors by the md5 of their texts, in folders by its first two digits: rows are added, never changed.

    Only the folders of the hashes in question are read. A vector is stored as little-endian float32, so a value comes
    back as the nearest float32. Of rows that two writers have added for one hash, equal by construction, one counts.
    """

    SCHEMA = "text_hash string, dim int, vector binary, digits string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self, digits: list[str] | None = None) -> DataFrame:
        """text_hash, dim, vector of the folders of ``digits`` (all by default)."""
        if not lineage.listed(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        out = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return out if digits is None else out.where(F.col("digits").isin(digits))

    def known(self, texts: DataFrame) -> DataFrame:
        """text_hash, dim, vector of the distinct ``texts`` (text_hash, text) that the cache has."""
        digits = [r["d"] for r in texts.select(F.substring("text_hash", 1, 2).alias("d")).distinct().collect()]  # 256 at most
        return self.rows(digits).join(texts.select("text_hash"), "text_hash", "left_semi").dropDuplicates(["text_hash"])

    @staticmethod
    def packed(vector: Column) -> Column:
        """An array of floats as little-endian float32 bytes."""

        @F.pandas_udf("binary")
        def pack(v):
            import numpy as np

            return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

        return pack(vector.cast("array<float>"))

    @staticmethod
    def unpacked(vector: Column) -> Column:
        """The inverse of :meth:`packed`."""

        @F.pandas_udf("array<float>")
        def unpack(v):
            import numpy as np

            return v.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

        return unpack(vector)

    def add(self, found: DataFrame) -> int:
        """Appends those rows (text_hash, vector as an array) whose hash is not there yet; returns how many."""
        new = found.where("text_hash is not null and vector is not null").dropDuplicates(["text_hash"])
        have = self.known(new.select("text_hash")).select("text_hash")
        fresh = lineage.kept(new.join(have, "text_hash", "left_anti").select("text_hash", F.size("vector").alias("dim"), self.packed(F.col("vector")).alias("vector"), F.substring("text_hash", 1, 2).alias("digits")))
        n = fresh.count()
        if n:
            fresh.repartition("digits").write.mode("append").partitionBy("digits").parquet(self.path)
        return n

    def encoded(self, df: DataFrame, text: str, encoder: Callable[[DataFrame], DataFrame], out: str = "vector") -> tuple[DataFrame, dict[str, int]]:
        """``df`` with the vectors of its texts, and the run's counts: rows, texts (distinct), hits and misses among them.

        ``encoder`` gets the distinct texts that the cache lacks (text_hash, text) and returns text_hash, vector; what it
        gives is added. Null texts have no vector and no hash; a column ``out`` is replaced, all others stay.
        """
        mark, source = own_name(df.columns, "h"), df.drop(out)
        rows = lineage.kept(source.withColumn(mark, F.md5(F.col(text).cast("binary"))))
        texts = lineage.kept(rows.where(F.col(mark).isNotNull()).groupBy(F.col(mark).alias("text_hash")).agg(F.first(text).alias("text")))
        have = lineage.kept(self.known(texts).select("text_hash"))
        missing = texts.join(have, "text_hash", "left_anti")
        added = self.add(encoder(missing))
        distinct, hits = texts.count(), have.count()
        every = self.known(texts).select(F.col("text_hash").alias(mark), self.unpacked(F.col("vector")).alias(out))
        return rows.join(every, mark, "left").drop(mark), {"rows": rows.count(), "texts": distinct, "hits": hits, "misses": distinct - hits, "added": added}


class MemoryStore:
    """What has been seen of each company and unit, merged batch by batch; old references are not read again.

    A version is a folder of the state, one row for each company and unit with its years (each with its first reference), and of the
    numbers of all batches in it. The last version that a marker file names counts, so a run that fails
    leaves the one before. A batch that is in it already changes nothing. Which references a batch had is written
    beside it, as the mark that they are processed.
    """

    def __init__(self, spark: SparkSession, path: str, unit: list[str]):
        self.spark, self.path, self.unit = spark, path.rstrip("/"), unit

    def _last(self) -> dict:
        names = [int(n.removesuffix(".json")) for n in lineage.listed(self.spark, f"{self.path}/versions") if n.endswith(".json")]
        return json.loads(lineage.read_file(self.spark, f"{self.path}/versions/{max(names):08d}.json")) if names else {"version": 0, "folder": None, "batches": []}

    def batches(self) -> list[int]:
        return self._last()["batches"]

    def state(self) -> DataFrame | None:
        """company, the unit's columns, years (sorted structs of year and ref_id), first_seen_year, last_confirmed_year; None before the first batch."""
        last = self._last()
        return self.spark.read.parquet(f"{self.path}/state/{last['folder']}") if last["version"] else None

    def unprocessed(self, refs: DataFrame) -> DataFrame:
        """The references that no batch has had. Those of batches that never came to a version count as not processed."""
        done = [f"{self.path}/marks/{b}" for b in self._last()["folders"]] if self._last()["version"] else []
        if not done:
            return refs
        return refs.join(self.spark.read.schema("done long").parquet(*done), F.col("ref_id") == F.col("done"), "left_anti")

    def merge(self, number: int, refs: DataFrame) -> bool:
        """Merges batch ``number`` of references (ref_id, company, the unit's columns, year); False if the state has it already.

        Years that come late, earlier ones too, find their place; repeated references change nothing.
        """
        last = self._last()
        if number in last["batches"]:
            return False
        keys = ["company", *self.unit]
        rows = lineage.kept(refs.select("ref_id", *keys, "year"))
        fresh = rows.groupBy(*keys, "year").agg(F.min("ref_id").alias("ref_id"))
        old = self.state()
        both = fresh if old is None else fresh.unionByName(old.select(*keys, F.explode("years").alias("y")).select(*keys, "y.year", "y.ref_id"))
        one = both.groupBy(*keys, "year").agg(F.min("ref_id").alias("ref_id")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("year", "ref_id"))).alias("years"))  # as many as a unit has years
        state = one.withColumn("first_seen_year", F.get("years", F.lit(0))["year"]).withColumn("last_confirmed_year", F.element_at("years", -1)["year"])
        folder = uuid.uuid4().hex
        state.write.parquet(f"{self.path}/state/{folder}")
        rows.select(F.col("ref_id").alias("done")).write.parquet(f"{self.path}/marks/{folder}")
        at = last["version"] + 1
        now = {"version": at, "folder": folder, "folders": [*last.get("folders", []), folder], "batches": sorted([*last["batches"], number])}
        if not lineage.write_new_file(self.spark, f"{self.path}/versions/{at:08d}.json", json.dumps(now)):
            raise RuntimeError(f"another writer has made version {at}")
        return True

    def events(self) -> DataFrame:
        """One event for each company, unit and year, as ``memory.events`` gives for all references."""
        from fathomline.operators import memory

        one = self.state().select("company", *self.unit, "first_seen_year", F.explode("years").alias("y"))
        kind = F.when(F.col("y.year") > F.col("first_seen_year"), memory.CONFIRMED).otherwise(memory.NEW)
        return one.select("company", *self.unit, "y.year", "y.ref_id", kind.alias("event_type"))

    def portfolio(self, years: DataFrame, silent: int | None = None) -> DataFrame:
        """First and last year of each unit, and whether and when it was discontinued, as ``memory.portfolio`` gives for all references."""
        from fathomline.operators import memory

        seen = self.state().select("company", *self.unit, F.explode(F.array("first_seen_year", "last_confirmed_year")).alias("year"))
        return memory.portfolio(seen, self.unit, years, silent=memory.SILENT_YEARS if silent is None else silent)
