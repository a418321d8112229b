"""Study tables derived from the driver's tables, for queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.session import table


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, population, pos, marker, dosage (0, 1, 2)."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("P"), (F.col("label") % 5).cast("string")).alias("population"), F.posexplode("embedding").alias("pos", "x")
    )
    x = F.col("x").cast("double")
    return cells.select(
        "id", "population", "pos", F.concat(F.lit("m"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("marker"),
        F.when(x < -0.0555, 0).when(x > 0.0557, 2).otherwise(1).alias("dosage"),
    )


def pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, population, phenotype (DTA, PLH), y; null where the id is a multiple of 17."""
    pos, dosage, one = F.col("pos"), F.col("dosage"), lambda k: F.max(F.when(F.col("pos") == k, F.col("dosage")).otherwise(0))
    sums = geno(spark, sf_dir).groupBy("id", "population").agg(
        (F.sum(((pos * 37) % 11 - 5) * dosage * 10) + 50 * one(3) * one(7)).alias("DTA"), F.sum(((pos * 23) % 13 - 6) * dosage * 10).alias("PLH")
    )
    y = F.when(F.col("id") % 17 != 0, (F.col("s") + (F.col("id") * 7919) % 101).cast("double") / 100)
    return sums.unpivot(["id", "population"], ["DTA", "PLH"], "phenotype", "s").select("id", "population", "phenotype", y.alias("y"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker places; the last marker has none."""
    pos = F.col("pos")
    return geno(spark, sf_dir).where("pos < 63").select("marker", "pos").distinct().select(
        F.col("marker").alias("name"),
        (F.floor(pos / 8) + 1).cast("int").alias("chromosome"),
        *(((pos % 8) * 1_000_000 + k).cast("long").alias(n) for n, k in (("start", 500), ("middle", 5500), ("end", 10500))),
    )


def chromosomes(spark: SparkSession) -> DataFrame:
    return spark.range(1, 8).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chromosome"), F.lit(0).cast("long").alias("start"), F.lit(6_000_000).cast("long").alias("end"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    start = (key * 7919) % 8_000_000
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("chr"), (key % 8 + 1).cast("string")).alias("chromosome"), start.alias("start"), (start + F.col("p_size") * 2000).alias("end"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("class"), key.alias("gene_id"),
    )


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three models at the scale of lineitem, in long form; rows keep their line's columns as key."""
    d = lambda c: F.col(c).cast("double")
    actual = d("l_extendedprice") / 1000
    members = {"rrBLUP": d("l_quantity") * 1.5, "BayesB": d("l_quantity") * 1.4 + d("l_discount"), "RF": actual * (1 - d("l_discount"))}
    each = F.array(*(F.struct(F.lit(k).alias("model"), v.alias("predicted")) for k, v in members.items()))
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEYS, F.col("l_returnflag").alias("population"), F.col("l_linestatus").alias("phenotype"), F.lit(0.8).alias("ratio"),
        F.col("l_linenumber").cast("int").alias("sample"), actual.alias("actual"), F.explode(each).alias("m"),
    ).select("*", "m.model", "m.predicted").drop("m")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed effects at the scale of events."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("P"), (F.col("event_id") % 5).cast("string")).alias("population"), F.lit("DTA").alias("phenotype"), F.col("event_type").alias("model"),
        F.concat(F.lit("m"), F.lpad((F.col("user_id") % 64).cast("string"), 2, "0")).alias("marker"), F.col("event_id").alias("sample"), (F.col("value").cast("double") - 50).alias("effect"),
    )
