"""A stored collection as levels of sorted runs behind a numbered version.

An append writes one run: the last write of each key, in folders by a hash of the key, sorted, in files of
separate key ranges.  A version is a small file that lists the runs it is made of; it is written whole and then given its number, which fails
if another writer took that number first, and the writer tries again on top.  So a reader sees one version, whole,
whatever is written meanwhile, and several programs can open the same folder.  When a level has ``fanout`` runs, they are
merged into one of the next level, so a row is rewritten about as often as the logarithm of the number of appends.

A lookup of a key reads the folder of its hash, and in it the files and row groups whose range has the key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .stores import folder_names, remove

ROWS_PER_FILE = 2_000_000


@dataclass(frozen=True)
class RunStore:
    """Rows of ``schema``, which has the key, a whole-number ``seq`` that orders the writes, and any other columns."""

    spark: SparkSession
    path: str

    # ------------------------------------------------------------ versions

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str = "key", buckets: int = 16, fanout: int = 4) -> RunStore:
        """Makes an empty collection, or opens the one that is there."""
        store = cls(spark, path)
        if not store.versions():
            store._publish(0, {"schema": schema, "key": key, "buckets": buckets, "fanout": fanout, "runs": []})
        return store

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in folder_names(self.spark, f"{self.path}/versions") if n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no collection in {self.path}")
        number = known[-1] if version is None else version
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(self._fs().open(self._place(f"versions/{number:012d}.json")), "UTF-8")
        return json.loads(text) | {"version": number}

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._place("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _publish(self, number: int, state: dict) -> bool:
        """Gives a version its number; False if the number is taken."""
        jvm, fs = self.spark._jvm, self._fs()
        draft = self._place(f"versions/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "version"}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._place(f"versions/{number:012d}.json"), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            if "AlreadyExists" not in str(e):
                raise
            return False
        return True

    def _commit(self, gone: list[dict], new: list[dict]) -> bool:
        """Takes runs out of the newest version and puts others in; False if one of those that go has gone already."""
        while True:
            state = self.state()
            names = {r["name"] for r in state["runs"]}
            if any(r["name"] not in names for r in gone):
                return False
            out = {r["name"] for r in gone}
            runs = [r for r in state["runs"] if r["name"] not in out] + new
            if self._publish(state["version"] + 1, state | {"runs": runs}):
                return True

    # ------------------------------------------------------------ writes

    def append(self, rows: DataFrame) -> RunStore:
        """One run of these rows; of a key's several writes the one of the largest ``seq`` is kept."""
        self._commit([], [self._run(rows.withColumn("_gone", F.lit(False)), 0)])
        return self.merge()

    def delete(self, keys: DataFrame, seq: int | Column) -> RunStore:
        """Keys (key) have no value from ``seq`` on, until they are written again."""
        state = self.state()
        names = [f.name for f in self._typed(state).fields]
        row = [F.col(state["key"]) if n == state["key"] else (seq if isinstance(seq, Column) else F.lit(seq)).alias(n) if n == "seq" else F.lit(None).alias(n) for n in names]
        self._commit([], [self._run(keys.select(*row, F.lit(True).alias("_gone")), 0)])
        return self.merge()

    def merge(self, all_levels: bool = False) -> RunStore:
        """Merges full levels, or everything."""
        while True:
            state = self.state()
            levels: dict[int, list[dict]] = {}
            for r in state["runs"]:
                levels.setdefault(0 if all_levels else r["level"], []).append(r)
            full = [(n, runs) for n, runs in sorted(levels.items()) if len(runs) >= (2 if all_levels else state["fanout"])]
            if not full:
                return self
            level, runs = full[0]
            whole = len(runs) == len(state["runs"])  # nothing older is left that a deletion would have to hide
            level = max(r["level"] for r in runs) if all_levels else level
            self._commit(runs, [self._run(self._rows(state, runs), level + 1, keep_gone=not whole)])

    def _run(self, rows: DataFrame, level: int, keep_gone: bool = True) -> dict:
        state = self.state()
        name = f"runs/{uuid.uuid4().hex}"
        last = self._last(state, rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._typed(state).fields], "_gone"))
        last = last if keep_gone else last.where(~F.col("_gone"))
        key = state["key"]
        last = last.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(state["buckets"])).cast("int"))
        if level == 0:
            last = last.repartition(state["buckets"], "_bucket")
        else:  # large runs are files of separate ranges
            last = last.repartitionByRange(max(state["buckets"], -(-sum(r["rows"] for r in state["runs"]) // ROWS_PER_FILE)), "_bucket", key)
        seen = Observation()
        last = last.sortWithinPartitions("_bucket", key).observe(seen, F.count(F.lit(1)).alias("rows"))
        last.write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        return {"name": name, "level": level, "rows": seen.get["rows"]}

    # ------------------------------------------------------------ reads

    def _typed(self, state: dict):
        from pyspark.sql.types import StructType

        return StructType.fromDDL(state["schema"])

    def _open(self, state: dict, runs: list[dict]) -> DataFrame:
        schema = self._typed(state).add("_gone", "boolean").add("_bucket", "integer")
        if not runs:
            return self.spark.createDataFrame([], schema)
        # Each run is a table of its own, so that its bucket folders are partitions.
        tables = [self.spark.read.schema(schema).parquet(f"{self.path}/{r['name']}") for r in runs]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionAll(t)
        return out

    def _rows(self, state: dict, runs: list[dict]) -> DataFrame:
        return self._open(state, runs).drop("_bucket")

    def _last(self, state: dict, rows: DataFrame) -> DataFrame:
        names = [f.name for f in self._typed(state).fields]
        rest = [n for n in names if n not in (state["key"], "seq")] + ["_gone"]
        last = rows.where(F.col(state["key"]).isNotNull()).groupBy(state["key"]).agg(F.max(F.struct(F.coalesce("seq", F.lit(-(1 << 62))).alias("s"), "_gone")).alias("m"), F.max_by(F.struct("seq", *rest), F.struct(F.coalesce("seq", F.lit(-(1 << 62))), "_gone")).alias("r"))
        return last.select(state["key"], *[F.col(f"r.{n}").alias(n) for n in names if n != state["key"]], F.col("r._gone").alias("_gone")).select(*names, "_gone")

    def read(self, version: int | None = None) -> DataFrame:
        """The last write of each key, as of a version."""
        state = self.state(version)
        runs = state["runs"]
        rows = self._rows(state, runs) if len(runs) == 1 else self._last(state, self._rows(state, runs))
        return rows.where(~F.col("_gone")).drop("_gone")

    def get(self, key, version: int | None = None) -> DataFrame:
        """The row of one key, or none."""
        state = self.state(version)
        kind = next(f.dataType for f in self._typed(state).fields if f.name == state["key"])
        value = F.lit(key).cast(kind)
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(value), F.lit(state["buckets"])).cast("int")).first()[0]
        rows = self._open(state, state["runs"]).where((F.col("_bucket") == bucket) & (F.col(state["key"]) == value)).drop("_bucket")
        return self._last(state, rows).where(~F.col("_gone")).drop("_gone")

    def vacuum(self, keep: int = 2) -> RunStore:
        """Deletes all but the newest versions, and the runs that only those had."""
        old, new = self.versions()[:-keep], self.versions()[-keep:]
        used = {r["name"] for v in new for r in self.state(v)["runs"]}
        gone = {r["name"] for v in old for r in self.state(v)["runs"]} - used
        for v in old:
            remove(self.spark, f"{self.path}/versions/{v:012d}.json")
        for name in gone:
            remove(self.spark, f"{self.path}/{name}")
        return self
