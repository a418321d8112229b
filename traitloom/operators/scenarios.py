"""Scenario grid, joins of data with scenarios, seeded splits and samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traitloom.functions import hashed_order


@dataclass(frozen=True)
class Sizes:
    """How large the models are. ``features`` are the random features that stand for a kernel, ``permutations`` and ``background``
    the orders and rows that sampled Shapley values average over. ``kernel`` (rbf, poly or linear), ``gamma`` (a number, or
    scale: one over the markers times their variance, or auto: one over the markers), ``degree`` and ``constant`` are those of
    the support vector regression."""

    trees: int = 1000
    depth: int = 30
    tree_share: float = 1.0
    hidden: int = 30
    dropout: float = 0.0
    rate: float = 1e-3
    decay: float = 5e-4
    epochs: int = 30
    batch: int = 8
    epsilon: float = 0.5
    cost: float = 1.0
    kernel: str = "rbf"
    gamma: float | str = "scale"
    degree: int = 3
    constant: float = 0.0
    features: int = 256
    permutations: int = 2
    background: int = 30


EXPLAIN = {"RKHS": 30, "RF": 30, "SVR": 30, "MLP": 10}


@dataclass(frozen=True)
class Study:
    """What a study tries. ``explain_rows``: test rows of a scenario that a model's effects are explained on, None for all
    of them; ``explained``: the models that give effects."""

    populations: tuple[str, ...]
    phenotypes: tuple[str, ...]
    ratios: tuple[float, ...] = (0.8,)
    samples: int = 1
    models: tuple[str, ...] = ("rrBLUP", "BayesB", "RKHS", "RF", "SVR", "MLP")
    explain_rows: dict = field(default_factory=lambda: dict(EXPLAIN))
    explained: tuple[str, ...] = ("rrBLUP", "BayesB", "RF", "MLP")
    sizes: Sizes = Sizes()


def grid(spark: SparkSession, study: Study) -> DataFrame:
    """population, phenotype, ratio, sample and scenario_id of every combination."""
    each = lambda values: F.explode(F.array(*(F.lit(v) for v in values)))
    out = spark.range(1).select(each(study.populations).alias("population")).withColumn("phenotype", each(study.phenotypes))
    out = out.withColumn("ratio", each(map(float, study.ratios))).withColumn("sample", each(range(1, study.samples + 1)))
    return out.select(F.concat_ws("|", "population", "phenotype", F.col("ratio").cast("string"), F.col("sample").cast("string")).alias("scenario_id"), "*")


def with_models(scenarios: DataFrame, study: Study) -> DataFrame:
    """Every scenario with every model but the ensemble, which is made of the others."""
    return scenarios.withColumn("model", F.explode(F.array(*(F.lit(m) for m in study.models if m != "ensemble"))))


def complete(geno: DataFrame, pheno: DataFrame) -> DataFrame:
    """Phenotype rows that have a target and no missing dosage; individuals without genotypes are left out. Repeated rows of
    a phenotype stay, other columns of ``pheno`` are passed on."""
    missing = geno.groupBy("id", "population").agg(F.count_if(F.col("dosage").isNull()).alias("missing")).where("missing = 0")
    return pheno.where("y IS NOT NULL").join(missing.select("id", "population"), ["id", "population"])


def hashed_rank(rows: DataFrame, by: list[str], *seed, to: str = "rank") -> DataFrame:
    """A column ``to`` with each row's rank from 1 in its group, in the order of a hash of the seed columns, then the id.
    Repeated rows get ranks of their own; nulls are values; an empty table stays empty.

    Rows are ranked inside the slices that the hash's first digits make, and a slice's offset comes from the slices'
    counts: no task sorts a whole group.
    """
    hashed = rows.withColumn("_h", hashed_order(*seed)).withColumn("_slice", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_h", "id"))
    ranked = hashed.withColumn("_in", inside).join(offsets, [*by, "_slice"])
    return ranked.withColumn(to, F.col("_before") + F.col("_in")).drop("_h", "_slice", "_in", "_before")


def split(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Rows joined with the scenarios of their population and phenotype, with a fold.

    floor(ratio * n) rows of a scenario are ``train``, in the order of a hash of id and sample; the rest are ``test``.
    """
    joined = rows.join(F.broadcast(scenarios), ["population", "phenotype"])
    sizes = joined.groupBy("scenario_id").agg(F.count("*").alias("_n"))
    ranked = hashed_rank(joined, ["scenario_id"], "id", "sample", to="_rank").join(F.broadcast(sizes), "scenario_id")
    fold = F.when(F.col("_rank") <= F.floor(F.col("ratio") * F.col("_n")), "train").otherwise("test")
    return ranked.withColumn("fold", fold).drop("_rank", "_n")


def sample_rows(rows: DataFrame, count: int | None, by: list[str], seed: str = "explain") -> DataFrame:
    """``count`` rows of each group in hashed order (all if there are fewer, or if count is None). Repeated rows
    count each; a null group is one."""
    if count is None:
        return rows
    return hashed_rank(rows, by, F.lit(seed), "id", to="_rank").where(F.col("_rank") <= count).drop("_rank")


def resolve_all(rows: DataFrame, count: int | None) -> DataFrame:
    """Rows to explain in each scenario: the given count, or all of its test rows."""
    tests = rows.groupBy("scenario_id").agg(F.count_if(F.col("fold") == "test").alias("n_test"))
    return tests.withColumn("n_explain", F.coalesce(F.lit(count).cast("long"), F.col("n_test")))
