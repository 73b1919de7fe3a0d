"""Streaming ingest of arriving batch files and incremental group means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascreen.functions import labels

SCHEMA = "cell_id bigint, condition_raw string, bin string, genes array<string>, counts array<bigint>"


def batch_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Files as they arrive; one row is one whole cell with paired arrays."""
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", True).parquet(folder)
    )


def clean_stream(cells: DataFrame, min_genes: int = 200, mito_max: float = 0.15, target_sum: float = 1e4) -> DataFrame:
    """Stateless per-cell steps: label, gates with a fixed cut-off, normalised entries.

    Per-cell sums run over the cell's own array, so nothing has to be remembered between files.
    """
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, v: a + v)
    pairs = F.arrays_zip(F.col("genes").alias("gene"), F.col("counts").alias("cnt"))
    is_mito = lambda g: F.upper(g).startswith("MT-") | F.upper(g).startswith("MT_")
    mito = F.aggregate(
        F.filter(pairs, lambda p: is_mito(p.gene)), F.lit(0).cast("bigint"), lambda a, p: a + p.cnt)
    kept = (
        cells.withColumn("condition", labels.clean_label(F.col("condition_raw")))
        .withColumn("total", total).withColumn("mito", mito)
        .where(F.col("condition").isNotNull() & (F.size(F.filter("counts", lambda c: c > 0)) >= min_genes))
        .where(F.coalesce(F.try_divide("mito", "total"), F.lit(0.0)) < mito_max)
        .where(F.col("total") > 0)
    )
    return kept.select(
        "cell_id", "condition", "bin", "total", F.explode(pairs).alias("e")
    ).select(
        "cell_id", "condition", "bin", F.col("e.gene").alias("gene"), F.col("e.cnt").alias("cnt"),
        F.log1p(F.col("e.cnt") * F.lit(target_sum) / F.col("total")).alias("x"),
    )


def start_ingest(stream: DataFrame, out: str, checkpoint: str):
    """Exactly-once parquet sink; stops when the available files are read."""
    return (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def start_incremental_means(stream: DataFrame, out: str, checkpoint: str):
    """Mergeable sums per (bin, condition, gene) and cells per (bin, condition), one folder per micro-batch.

    A retried batch overwrites its own folder, so every batch counts once. A row of the source is a
    whole cell, so the cells of different batches are different.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        x = F.col("x")
        sums = batch.groupBy("bin", "condition", "gene").agg(
            F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.count(F.lit(1)).alias("nnz"))
        sums.write.mode("overwrite").parquet(f"{out}/entries/batch={batch_id}")
        sizes = batch.groupBy("bin", "condition").agg(F.count_distinct("cell_id").alias("n_cells"))
        sizes.write.mode("overwrite").parquet(f"{out}/cells/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_incremental_means(spark: SparkSession, out: str) -> DataFrame:
    """Sums and means over all finished micro-batches; entries that are absent count as zero."""
    sums = spark.read.parquet(f"{out}/entries").groupBy("bin", "condition", "gene").agg(
        F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"), F.sum("nnz").alias("nnz"))
    sizes = spark.read.parquet(f"{out}/cells").groupBy("bin", "condition").agg(F.sum("n_cells").alias("n_cells"))
    return sums.join(sizes, ["bin", "condition"]).withColumn("m", F.col("sx") / F.col("n_cells"))
