"""User sources as tables: a registry of rows, and passages in a folder for each source.

Passages are keyed by (source_id, ord), so no shared id space needs compacting when a source goes. Only the registry, one row
a source, is ever rewritten; each version of it is a folder of its own, so a reader keeps the one it began with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking

REGISTRY = "source_id long, title string, kind string, added long, chars long, passages long, chunks long, enabled boolean, status string, stamp string"
#: Chunks of one source at most, and the characters under which a paste is refused.
MOST_CHUNKS, LEAST_CHARS = 20_000, 20


class SourceStore:
    """The sources below ``path`` (a URI all executors reach), made with the model that ``stamp`` names."""

    def __init__(self, spark: SparkSession, path: str, stamp: str):
        self.spark, self.path, self.stamp = spark, path.rstrip("/"), stamp
        self.version = 0
        self._rows(spark.createDataFrame([], REGISTRY))

    def _rows(self, rows: DataFrame) -> None:
        self.version += 1
        rows.write.parquet(f"{self.path}/registry-{self.version}")

    @property
    def registry(self) -> DataFrame:
        return self.spark.read.schema(REGISTRY).parquet(f"{self.path}/registry-{self.version}")

    def add(self, texts: DataFrame, added: Column, kind: str = "paste") -> None:
        """Sources from ``texts`` (source_id, text[, title]): normalised, cut to passages and chunks, and registered.

        A text under 20 characters is registered as an error. Passages end with the one of the last chunk that fits.
        """
        t = texts.withColumn("text", T.ingest_normalise(F.coalesce("text", F.lit(""))))
        title = F.coalesce(F.col("title"), T.first_line_title("text")) if "title" in t.columns else T.first_line_title("text")
        t = t.select("source_id", "text", title.alias("title"), (F.length("text") >= LEAST_CHARS).alias("good"), added.alias("added"))
        passages = chunking.to_passages(t.where("good"), "source_id", "text").join(t.select(F.col("source_id").alias("id"), "title"), "id")
        both = F.struct(F.col("id").alias("source_id"), F.col("k").alias("ord"))
        chunks = chunking.user_chunks(passages.select(both.alias("key"), "text", "title", "heading"), "key", "text", F.col("title"), F.col("heading"))
        # of a source's chunks the first MOST_CHUNKS, passage by passage: whole passages are counted, then the last one's
        per = chunks.groupBy("id").agg(F.count("*").alias("n")).select("id.source_id", "id.ord", "n")
        w = F.sum("n").over(_in_order())
        kept = per.withColumn("before", w - F.col("n")).where(F.col("before") < MOST_CHUNKS).select("source_id", "ord", F.least(F.col("n"), MOST_CHUNKS - F.col("before")).alias("n"))
        rows = passages.select(F.col("id").alias("source_id"), F.col("k").alias("ord"), "text", "heading").join(kept, ["source_id", "ord"])
        rows.write.mode("append").partitionBy("source_id").parquet(f"{self.path}/passages")
        counted = kept.groupBy("source_id").agg(F.count("*").alias("passages"), F.sum("n").alias("chunks"))
        new = t.join(counted, "source_id", "left").select(
            "source_id", "title", F.lit(kind).alias("kind"), F.col("added").cast("long"), F.length("text").cast("long").alias("chars"), F.coalesce("passages", F.lit(0)).alias("passages"),
            F.coalesce("chunks", F.lit(0)).alias("chunks"), F.col("good").alias("enabled"), F.when(F.col("good"), "ready").otherwise("error").alias("status"), F.lit(self.stamp).alias("stamp"),
        )
        self._rows(self.registry.unionByName(new))

    def enable(self, which: Column, on: bool) -> None:
        self._rows(self.registry.withColumn("enabled", F.when(which & (F.col("status") == "ready"), F.lit(on)).otherwise(F.col("enabled"))))

    def remove(self, which: Column) -> None:
        """Takes sources out of the registry; their folders are no longer read, and ``vacuum`` deletes them."""
        self._rows(self.registry.where(~F.coalesce(which, F.lit(False))))

    def clear(self) -> None:
        self._rows(self.registry.limit(0))

    def restore(self, registry: DataFrame) -> None:
        """Registers the rows of a snapshot that were made with the same model; others are dropped."""
        self._rows(registry.where(F.col("stamp") == self.stamp).select(*[f.name for f in self.registry.schema]))

    def vacuum(self) -> None:
        """Deletes the folders of sources that are not registered; one name a source goes to the driver."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/passages")
        store = folder.getFileSystem(conf)
        known = {f"source_id={r[0]}" for r in self.registry.select("source_id").collect()}
        for item in store.listStatus(folder) if store.exists(folder) else []:
            if (name := item.getPath().getName()).startswith("source_id=") and name not in known:
                store.delete(item.getPath(), True)

    def passages(self, enabled_only: bool = True) -> DataFrame:
        """(source_id, ord, text, heading, n) of registered sources; only their folders are read."""
        live = self.registry.where("status = 'ready'")
        live = live.where("enabled") if enabled_only else live
        return self.spark.read.parquet(f"{self.path}/passages").join(live.select("source_id"), "source_id", "left_semi")

    def searchable(self, corpus_on: bool) -> DataFrame:
        """One row: chunks in use, whether any source is on, and the refusal where there is nothing to search."""
        on = self.registry.where("enabled and status = 'ready'").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), (F.count("*") > 0).alias("any_on"))
        return on.select("chunks", "any_on", F.when(~F.lit(corpus_on) & ~F.col("any_on"), "NO_SOURCES").alias("refusal"))


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("source_id").orderBy("ord")
