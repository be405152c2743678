"""Tables of keyed rows that streams write into.

Rows lie in buckets by the hash of their key, so a key of many rows elsewhere
(a book, a host) is spread. A batch reads and rewrites only the buckets that
its keys fall in, under its own number, and then states in a log where every
bucket lies. Batch n reads what the log of the batch before it says: a batch
that is repeated after a failure reads the same rows, writes the same files,
and changes nothing else. With buckets of bounded size (their number is a
parameter) the cost of a batch follows its keys, not the batches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread

#: Logs whose buckets are kept by vacuum.
KEPT_LOGS = 2


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folders(self, path: str) -> list[int]:
        """Numbers of finished batches below a folder."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        done = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(root) if s.getPath().getName().startswith("batch=") and done(s.getPath()))

    def layout(self, before: int | None = None) -> dict[int, int]:
        """Of each bucket the batch that wrote it last, before a batch."""
        logs = [n for n in self._folders(f"{self.path}/log") if before is None or n < before]
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.path}/log/batch={logs[-1]}").collect()} if logs else {}  # a row a bucket

    def _rows(self, layout: dict[int, int], wanted) -> DataFrame:
        paths = [f"{self.path}/data/batch={layout[b]}/bucket={b}" for b in sorted(wanted) if b in layout]
        return spread(self.spark.read.schema(self.schema).parquet(*paths)) if paths else self.spark.createDataFrame([], self.schema)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # a row a bucket

    def read(self) -> DataFrame:
        """All rows, as the newest finished batch left them."""
        layout = self.layout()
        return self._rows(layout, layout)

    def near(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of the buckets that the keys of `rows` fall in, as they were
        before a batch: all rows of those keys are among them."""
        return self._rows(self.layout(before), self._touched(rows))

    def merge(self, rows: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """Puts rows (written; each key once) in place of those of their keys,
        and takes those of the keys of `gone` out that rows do not have."""
        named = rows.select(*self.keys)
        named = named if gone is None else named.unionByName(gone.select(*self.keys)).distinct()
        layout, touched = self.layout(batch), self._touched(named)
        if touched:
            columns = self.spark.createDataFrame([], self.schema).columns
            kept = self._rows(layout, touched).join(named, self.keys, "left_anti")
            merged = kept.select(*columns).unionByName(rows.select(*columns)).withColumn("bucket", self._bucket())
            # every task writes into the folders of its rows' buckets: rows are not shuffled for it, and no task has a whole bucket
            merged.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        placed = layout | dict.fromkeys(touched, batch)
        self.spark.createDataFrame(list(placed.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def vacuum(self) -> int:
        """Deletes bucket files that none of the newest KEPT_LOGS logs names, and
        older logs; how many buckets went. Not while readers use older ones."""
        logs = self._folders(f"{self.path}/log")
        named = {(b, n) for at in logs[-KEPT_LOGS:] for b, n in self.layout(at + 1).items()}
        fs = self.spark._jvm.org.apache.hadoop.fs
        files, gone = fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for n in self._folders(f"{self.path}/data"):
            for s in files.listStatus(fs.Path(f"{self.path}/data/batch={n}")):
                name = s.getPath().getName()
                if name.startswith("bucket=") and (int(name.split("=")[1]), n) not in named and n <= logs[-1]:
                    gone += files.delete(s.getPath(), True)
        for n in logs[:-KEPT_LOGS]:
            files.delete(fs.Path(f"{self.path}/log/batch={n}"), True)
        return gone
