"""Tables in a folder, changed bucket by bucket, with one manifest that says which files make up all of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Snapshots:
    """Tables below ``root`` whose rows lie in buckets by a hash of a key.

    A change writes the buckets it touches to a new folder and then one small manifest for all tables, which is put in place
    by a rename; so readers see either none or all of a change. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], keys: dict[str, str], buckets: int = 64) -> None:
        self.spark, self.root, self.schemas, self.keys, self.buckets = spark, root.rstrip("/"), schemas, keys, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self) -> dict[str, dict[str, str]]:
        """For each table the folder of each of its buckets."""
        numbers = self._numbers()
        if not numbers:
            return {}
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/manifests/{numbers[-1]}.json").collect()))

    def bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as of the last change, or some buckets of it."""
        held = self.manifest().get(name, {})
        paths = [p for b, p in held.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*(f"{self.root}/{p}" for p in paths))

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys in the only column of ``keys``."""
        return [r[0] for r in keys.select(self.bucket(keys.columns[0])).distinct().collect()]  # at most ``buckets``

    def commit(self, changes: dict[str, tuple[DataFrame, list[int] | None]]) -> None:
        """Put the rows given for each table in the place of its buckets named, or of all."""
        number = max(self._numbers(), default=0) + 1
        manifest = self.manifest()
        for name, (rows, buckets) in changes.items():
            folder = f"{name}/c{number}"
            typed = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schemas[name]))
            marked = typed.withColumn("_bucket", self.bucket(self.keys[name]))
            marked.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            fs = self._fs()
            written = [s.getPath().getName().removeprefix("_bucket=") for s in fs.listStatus(self._path(folder)) if s.isDirectory()]
            kept = {b: p for b, p in manifest.get(name, {}).items() if buckets is not None and int(b) not in buckets}
            manifest[name] = kept | {b: f"{folder}/_bucket={b}" for b in written}
        fs, to = self._fs(), self._path(f"manifests/{number}.json")
        draft = self._path(f"manifests/{number}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(draft, to):
            raise RuntimeError(f"change {number} was made by another writer")

    def vacuum(self) -> int:
        """Delete what the last manifest does not name, and say how many folders; readers of older changes fail then."""
        held = {p for own in self.manifest().values() for p in own.values()}
        fs, gone = self._fs(), 0
        for name in self.schemas:
            if not fs.exists(self._path(name)):
                continue
            for change in fs.listStatus(self._path(name)):
                own = [f"{name}/{change.getPath().getName()}/{b.getPath().getName()}" for b in fs.listStatus(change.getPath()) if b.isDirectory()]
                live = [p for p in own if p in held]
                for p in set(own) - set(live):
                    gone += bool(fs.delete(self._path(p), True))
                if not live:
                    fs.delete(change.getPath(), True)
        for number in self._numbers()[:-1]:
            fs.delete(self._path(f"manifests/{number}.json"), False)
        return gone
