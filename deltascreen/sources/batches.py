"""Reading raw inputs: ragged parquet batches, matrix-market triplets, multi-file unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path, columns: list[str], predicate=None, schema: T.StructType | None = None) -> DataFrame:
    """Projected parquet scan; the predicate and the columns reach the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return (df if predicate is None else df.where(predicate)).select(*columns)


def condition_counts(batches: DataFrame, condition: str) -> DataFrame:
    """Rows per condition over all batches, from one narrow column."""
    return batches.groupBy(condition).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(tokens: DataFrame, name: str = "name", token: str = "token", drop_prefix: str = "ENSG") -> DataFrame:
    """Smallest token per name, without names that start with an accession prefix."""
    return (
        tokens.where(~F.col(name).startswith(drop_prefix))
        .groupBy(F.col(name).alias("gene")).agg(F.min(token).alias("token"))
    )


def explode_ragged(
    rows: DataFrame, vocab: DataFrame, id_col: str = "cell_id", tokens: str = "tokens", values: str = "values"
) -> DataFrame:
    """Paired arrays -> one row per entry; unknown tokens drop out in the join with the panel."""
    entries = rows.select(id_col, F.explode(F.arrays_zip(F.col(tokens).alias("token"), F.col(values).alias("value"))).alias("e"))
    return entries.select(id_col, F.col("e.token").alias("token"), F.col("e.value").alias("value")).join(
        vocab.select("gene", "token"), "token").select(id_col, "gene", "value")


def to_ragged(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row per cell with paired arrays (as long as the features of that cell)."""
    entry = F.array_sort(F.collect_list(F.struct("token", "cnt")))
    packed = counts.join(vocab, "gene").groupBy("cell_id").agg(entry.alias("e"))
    return packed.select("cell_id", F.col("e.token").alias("tokens"), F.col("e.cnt").alias("values"))


def positioned_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the split they stand in (``file``, ``start``) and a number ``at`` that rises inside it.

    The number is made in the scan, and nothing is pushed below it, so two scans of the same files agree.
    """
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))


def numbered_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated lines with their 1-based line number over all files, in the order of their names.

    Each split's lines are counted, and the counts are carried on over the splits (one row each, no more than the
    scan itself lists). Blank lines count but are left out; absent columns are null.
    """
    lines = positioned_lines(spark, path)
    split = ["file", "start"]
    sizes = lines.groupBy(*split).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1))
    offset = sizes.select(*split, (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    parts = F.split("line", "\t")
    return lines.where(F.trim("line") != "").join(offset, split).select(
        (F.col("at") + F.col("shift")).alias("idx"), *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def coordinate_head(lines: DataFrame) -> tuple[dict, Row]:
    """Declared field, rows, columns and entries of a coordinate matrix, and where its size line stands.

    The banner may stand in any file; the size line is the first plain line below it. The jobs stop at the first
    hit. A missing banner, another kind of matrix (dense, pattern, complex, symmetric) or a size line that is not
    three numbers raises ``ValueError``.
    """
    banner = lines.where((F.col("start") == 0) & F.lower("line").startswith("%%matrixmarket")).select("line", "file").first()
    if banner is None:
        raise ValueError("no file has a coordinate banner")
    kind = banner.line.lower().split()[1:]
    if len(kind) != 4 or kind[:2] != ["matrix", "coordinate"] or kind[2] not in ("integer", "real") or kind[3] != "general":
        raise ValueError(f"only general coordinate matrices of integers or reals are read, not {' '.join(kind)!r}")
    head = lines.where((F.col("start") == 0) & (F.col("file") == banner.file) & _plain("line")).first()
    size = head.line.split() if head else []
    if len(size) != 3 or not all(x.isdigit() for x in size):
        raise ValueError(f"no size line of three numbers: {head.line if head else ''!r}")
    return dict(zip(("rows", "columns", "entries"), map(int, size)), field=kind[2]), head


def _plain(line: str) -> Column:
    return ~F.ltrim(line).startswith("%") & (F.trim(line) != "")


def read_matrix_market(spark: SparkSession, matrix: str, features: str, barcodes: str, check_entries: bool = True) -> DataFrame:
    """(barcode, gene, cnt) from coordinate files, oriented by the declared shape.

    A square shape is read as features by barcodes. A shape that fits neither orientation and, unless
    ``check_entries`` is off, another number of entries than declared raise ``ValueError``; an index outside the
    shape fails the job. Counts are whole numbers or doubles, as the banner says. Packed files are read as one split.
    """
    lines = positioned_lines(spark, matrix)
    declared, head = coordinate_head(lines)
    genes = numbered_lines(spark, features, ["gene_id", "gene", "kind"])
    cells = numbered_lines(spark, barcodes, ["barcode"])
    shape, given = (genes.count(), cells.count()), (declared["rows"], declared["columns"])
    if given not in (shape, shape[::-1]):
        raise ValueError(f"matrix {given[0]} x {given[1]} does not fit {shape[0]} features and {shape[1]} barcodes")
    is_head = (F.col("file") == head.file) & (F.col("at") == head.at)
    entries = lines.where(_plain("line") & ~is_head)
    if check_entries and (found := entries.count()) != declared["entries"]:
        raise ValueError(f"{found} entries where {declared['entries']} are declared")
    f = F.split(F.trim("line"), r"\s+")

    def index(k: int, limit: int) -> Column:
        at = f[k].cast("bigint")
        return F.when(at.between(1, limit), at).otherwise(F.raise_error(F.concat(F.lit("index outside the matrix: "), "line")).cast("bigint"))

    value = f[2].cast("bigint" if declared["field"] == "integer" else "double")
    triplets = entries.select(index(0, given[0]).alias("i"), index(1, given[1]).alias("j"), value.alias("cnt"))
    g, c = ("i", "j") if given == shape else ("j", "i")
    return (
        triplets.join(genes.select(F.col("idx").alias(g), "gene"), g)
        .join(cells.select(F.col("idx").alias(c), "barcode"), c)
        .select("barcode", "gene", "cnt")
    )


def write_matrix_market(counts: DataFrame, folder: str, n_genes: int, n_cells: int) -> None:
    """Coordinate folder: one banner file and any number of triplet parts (``gi``, ``ci``, ``cnt``)."""
    spark = counts.sparkSession
    line = F.concat_ws(" ", "gi", "ci", "cnt")
    counts.select(line.alias("value")).write.mode("append").text(folder)
    head = ["%%MatrixMarket matrix coordinate integer general", f"{n_genes} {n_cells} {counts.count()}"]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("append").text(folder)


def unique_genes(expr: DataFrame, var: DataFrame) -> DataFrame:
    """Drop every copy of a repeated feature name."""
    once = var.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("gene")
    return expr.join(once, "gene", "left_semi")


def union_shared(parts: list[DataFrame], suffix: bool = True) -> DataFrame:
    """Union of sources on their shared features; ids get the number of their source."""
    axes = [p.select("gene").distinct() for p in parts]
    shared = reduce(DataFrame.intersect, axes)
    named = [
        p.withColumn("cell_id", F.concat_ws("-", F.col("cell_id").cast("string"), F.lit(str(i)))) if suffix else p
        for i, p in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, named).join(shared, "gene", "left_semi")
