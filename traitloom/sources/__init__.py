"""Readers and writers of the study's files. Every reader has an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.sources.wide import WideTable

MARKERS = "name string, chromosome int, start long, middle long, end long"
CHROMOSOMES = "chromosome string, start long, end long"
REGIONS = "chromosome string, start long, end long, name string, class string"


def read_wide(spark: SparkSession, path: str, phenotypes: int) -> tuple[DataFrame, DataFrame]:
    """Genotypes (id, population, marker, pos, dosage) and phenotypes (id, population, phenotype, y) of a CSV table with one
    column a marker, long; see ``WideTable``."""
    table = WideTable(spark, path, phenotypes)
    return table.genotypes(), table.phenotypes()


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Marker coordinates (CSV with a header)."""
    return spark.read.schema(MARKERS).option("header", True).csv(path)


def _population(path, prefix: str):
    """The file name's part between the prefix and the ending; null for the file that covers all populations."""
    part = F.regexp_extract(F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1), f"^{prefix}_(.+)$", 1)
    return F.when(part != "", part)


def _tsv(spark: SparkSession, paths: str, schema: str, prefix: str) -> DataFrame:
    table = (
        spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(paths)
    )
    return table.withColumn("population", _population(F.col("_metadata.file_name"), prefix))


def read_chromosomes(spark: SparkSession, paths: str, prefix: str = "chrom") -> DataFrame:
    """Chromosome bounds (BED with a header) of one or many files; ``population`` comes from the file's name."""
    return _tsv(spark, paths, CHROMOSOMES, prefix)


def read_regions(spark: SparkSession, paths: str, gene_set: str) -> DataFrame:
    """Known regions (TSV); the last two columns are name and class whatever their headers say."""
    return _tsv(spark, paths, REGIONS, gene_set).withColumn("gene_set", F.lit(gene_set))


def write_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, skip_empty: bool = False, order: list[str] | None = None) -> bool:
    """Write a result; with ``skip_empty`` nothing is written if there are no rows. Returns whether it was written.

    With ``order`` the files, in the order of their names, hold the rows in that order: Spark sorts by ranges, no task
    sorts all.
    """
    if skip_empty and df.isEmpty():
        return False
    if order:
        df = df.orderBy(*order)
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if form in ("csv", "tsv"):
        writer.option("header", True).option("sep", "," if form == "csv" else "\t").csv(path)
    else:
        writer.format(form).save(path)
    return True


def wide_predictions(predictions: DataFrame, models: list[str], fold: str) -> DataFrame:
    """One row a scenario and individual, one column a model."""
    keys = [c for c in ("population", "phenotype", "ratio", "sample", "id", "actual") if c in predictions.columns]
    return predictions.where(F.col("fold") == fold).groupBy(*keys).pivot("model", models).agg(F.first("predicted"))


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Results added to earlier ones; a column that one side lacks is null there. Repeated rows stay."""
    return old.unionByName(new, allowMissingColumns=True)
