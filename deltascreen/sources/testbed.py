"""Adapter: the TPC-H-like tables seen as cells, counts and genes.

orders are cells, lineitem quantities are counts, part brands are genes. Every frame is a lazy
transformation of the given parquet tables; ``stage`` writes the shared intermediate tables once
per session, the way a deployed run stores them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascreen.operators import bulk, deg, entries, qc, sampling, splits
from deltascreen.operators.scale import cut, cut_by, tasks_for

MIN_GENES = 2
N_FOLDS = 5
CALL_ALPHA = 0.2
# stored in buckets of cell_id: entries and cells are exchanged by cell once, when they are written
BY_CELL = ("counts", "qc_cells", "half_cells", "expr")


class Testbed:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._stages: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ---- views over the given tables -------------------------------------------------
    @staticmethod
    def _gene(brand):
        return F.when(brand.isin("Brand#24", "Brand#25"), F.concat(F.lit("MT-"), brand)).otherwise(
            brand
        )

    @property
    def genes(self) -> DataFrame:
        return self.stage("genes")

    def _build_genes(self) -> DataFrame:
        named = self.table("part").select(self._gene(F.col("p_brand")).alias("gene")).distinct()
        return bulk.number_genes(named).withColumn("is_mt", F.col("gene").startswith("MT-"))

    @property
    def counts(self) -> DataFrame:
        """The stored count table every job starts from."""
        return self.stage("counts")

    def _build_counts(self) -> DataFrame:
        """One row per (cell, gene), one shuffle, cells kept together in the files."""
        part = self.table("part").select("p_partkey", self._gene(F.col("p_brand")).alias("gene"))
        items = self.table("lineitem").select(
            F.col("l_orderkey").alias("cell_id"),
            "l_partkey",
            F.col("l_quantity").cast("long").alias("q"),
        )
        return (
            items.join(part, items.l_partkey == part.p_partkey)
            .select("cell_id", "gene", "q")
            .repartition(self.tasks, "cell_id")
            .groupBy("cell_id", "gene")
            .agg(F.sum("q").alias("cnt"))
        )

    @cached_property
    def cells(self) -> DataFrame:
        key, m = F.col("o_orderkey"), F.col("o_custkey") % 12
        condition = (
            F.when(m == 0, "control")
            .when(m.between(1, 6), F.concat(F.lit("Brand#"), m.cast("string")))
            .when(m == 7, "Brand#1+Brand#2")
            .when(m == 8, "Brand#3+Brand#4")
            .when(m == 9, "Brand#1@0.5")
            .when(m == 10, "Brand#2@0.25")
            .otherwise("Brand#99")
        )
        raw = (
            F.when(key % 50 == 0, "nan")
            .when(key % 50 == 1, "Non-Targeting")
            .when(key % 50 == 2, "Brand#2+Brand#1_3")
            .when(key % 50 == 3, "Brand#1+*")
            .when(key % 50 == 4, "Brand#1_2")
            .otherwise(F.col("condition"))
        )
        guide = (
            F.when(key % 11 == 0, "nan")
            .when(key % 11 == 1, "Brand#1_1;Brand#2_1;Brand#3_2")
            .otherwise("NO_SITE_4")
        )
        return (
            self.table("orders")
            .select("o_orderkey", "o_custkey", "o_orderstatus")
            .withColumn("condition", condition)
            .select(
                key.alias("cell_id"),
                raw.alias("condition_raw"),
                "condition",
                F.concat(F.lit("bin_"), "o_orderstatus").alias("bin"),
                F.concat(F.lit("lane_"), (key % 4).cast("string")).alias("batch"),
                guide.alias("guide"),
            )
        )

    @cached_property
    def signal(self) -> DataFrame:
        n = F.count(F.lit(1))
        return (
            self.cells.where("condition <> 'control'")
            .groupBy("bin", F.col("condition").alias("ko"))
            .agg(
                ((n % 7) / F.lit(2.0)).alias("snr"),
                ((n % 10) / F.lit(10.0)).alias("rho"),
                ((n % 13) / F.lit(4.0)).alias("e_distance"),
                ((n % 20) / F.lit(100.0)).alias("e_test_p"),
            )
        )

    @cached_property
    def relation(self) -> DataFrame:
        """Gene relations: an equi-join on the residue class instead of all pairs."""
        a = self.genes.select(F.col("gene").alias("src"), (F.col("gene_ord") % 5).alias("r"))
        b = self.genes.select(F.col("gene").alias("dst"), ((5 - F.col("gene_ord") % 5) % 5).alias("r"))
        return a.join(b, "r").where("src <> dst").select(F.lit("go").alias("kind"), "src", "dst")

    # ---- derived tables, unstaged ----------------------------------------------------
    @cached_property
    def totals(self) -> DataFrame:
        return qc.cell_totals(self.counts)

    @property
    def qc_cells(self) -> DataFrame:
        """Cells that pass the minimum-genes gate, with their total (stored)."""
        return self.stage("qc_cells")

    def _build_qc_cells(self) -> DataFrame:
        return self.cells.join(
            self.totals.where(F.col("n_genes") >= MIN_GENES).select("cell_id", "total"), "cell_id"
        )

    @cached_property
    def half_cells(self) -> DataFrame:
        return sampling.assign_halves(self.qc_cells, ["bin", "condition"], seed=42)

    @cached_property
    def expr(self) -> DataFrame:
        """CP-10k ratio v and its log1p x, for cells that pass the gate."""
        return qc.normalise(self.counts, self.qc_cells.select("cell_id", "total"), depth="total")

    # ---- staged tables ---------------------------------------------------------------
    @cached_property
    def tasks(self) -> int:
        """Parts of the tables that are kept by cell (counting a parquet table reads its footers only)."""
        return tasks_for(self.spark, self.table("lineitem").count())

    def stage(self, name: str, build=None) -> DataFrame:
        if name not in self._stages:
            built = (build or getattr(self, f"_build_{name}"))()
            by_cell = name in BY_CELL
            self._stages[name] = cut_by(built, name, "cell_id", self.tasks) if by_cell else cut(built, name)
        return self._stages[name]

    def _build_half_cells(self):
        return self.half_cells

    def _build_expr(self):
        """Entries with their cell's group, from the one join by cell."""
        return qc.normalise(self.counts, self.stage("half_cells"), depth="total", carry=entries.GROUP)

    def _build_sums(self):
        return entries.moments(self.stage("expr"))

    def _build_ctrl(self):
        return bulk.control_bulk(self.stage("expr"), self.stage("half_cells"), self.stage("genes"), self.stage("sums"))

    def _build_bulk(self):
        return bulk.half_bulk(self.stage("expr"), self.stage("half_cells"), self.stage("genes"), sums=self.stage("sums"))

    def _build_deltas(self):
        return bulk.deltas(self.stage("bulk"), self.stage("ctrl"))

    def _build_deg(self):
        return deg.rank_test(
            self.stage("expr"), self.stage("half_cells"), self.stage("genes"),
            kos=self.kos.select("ko"),
        )

    def _build_weights(self):
        return deg.gene_weights(self.called, alpha=CALL_ALPHA)

    @property
    def called(self) -> DataFrame:
        """Calls on unadjusted p: the given tables hold no effect that survives adjustment."""
        return self.stage("deg").where("half = 'all'").withColumn("padj", F.col("p"))

    def _build_pair_split(self):
        return splits.all_pair_splits(self.pairs, n_folds=N_FOLDS)

    def _build_rect(self):
        return splits.rectangle(self.stage("pair_split"), "test")

    @property
    def kos(self) -> DataFrame:
        return self.stage("deltas").select("ko").distinct()

    @property
    def pairs(self) -> DataFrame:
        return self.stage("deltas").select("bin", "ko").distinct()

    def split(self, scenario: str) -> DataFrame:
        return self.stage("pair_split").where(F.col("scenario") == scenario)


_OPEN: dict[tuple[str, str], Testbed] = {}


def open_testbed(spark: SparkSession, sf_dir: str) -> Testbed:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Testbed(spark, sf_dir)
    return _OPEN[key]


def forget() -> None:
    """Drop every staged table handle, so the next query starts from the given tables."""
    _OPEN.clear()
