"""A sweep that is started again, and interval joins of long, dense and piled-up regions."""

import random

import numpy as np
import pytest

from traitloom.operators import regions, scenarios
from traitloom.plans import study

SCHEMA = "key int, chromosome string, start long, end long"


def drawn(count, seed):
    """Short regions in one place, long ones over the chromosome, and odd ones."""
    draw = random.Random(seed)
    out = []
    for k in range(count):
        start = draw.choice([draw.randrange(3_000_000), 1_000_000 + draw.randrange(2_000), draw.randrange(20)])
        length = draw.choice([0, 1, draw.randrange(900), draw.randrange(50_000), draw.randrange(2_900_000), 8_000 - 1, 8_000, 64_000])
        out.append((k, draw.choice(["chr1", "chr1", "chr2"]), start, start + length))
    return out + [(count, None, 1, 2), (count + 1, "chr1", None, 5), (count + 2, "chr1", 9, 3), (0, *out[0][1:])]


@pytest.mark.parametrize("width,hot", [(1_000, 10_000), (1_000, 7), (10, 40), (100_000, 25)])
def test_long_and_dense_regions_against_brute_force(spark, width, hot):
    a, b = drawn(150, 1), drawn(120, 2)
    left, right = spark.createDataFrame(a, SCHEMA).repartition(3), spark.createDataFrame(b, SCHEMA)
    want = sorted((x[0], y[0]) for x in a for y in b if None not in (*x, *y) and x[2] <= x[3] and y[2] <= y[3] and x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])
    met = regions.overlaps(left, right, width, hot)
    assert met.columns == ["key", "chromosome", "start", "end", "known_key", "known_chromosome", "known_start", "known_end"]
    assert sorted((r.key, r.known_key) for r in met.collect()) == want


def test_a_long_region_is_placed_in_few_bins(spark):
    whole = spark.createDataFrame([(1, "chr1", 0, 300_000_000), (2, "chr1", 5, 5)], SCHEMA)
    placed = regions._placed(whole, "start", "end", regions.BIN).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in placed}[1] <= 12 and {r.key: r["count"] for r in placed}[2] == regions.LEVELS


def test_a_sweep_that_is_started_again(spark, tmp_path, monkeypatch):
    """Killed in its third group, then started again with another group size: the same rows as one run, and none twice."""
    draw = np.random.default_rng(3)
    x = draw.integers(0, 3, (40, 4))
    geno = spark.createDataFrame([(i, f"P{i % 2}", j, f"m{j}", int(x[i, j])) for i in range(40) for j in range(4)], "id long, population string, pos int, marker string, dosage int")
    pheno = spark.createDataFrame([(i, f"P{i % 2}", t, float(x[i] @ [1, 2, 0, k] + i % 3)) for i in range(40) for k, t in enumerate("AB")], "id long, population string, phenotype string, y double")
    asked = scenarios.Study(("P0", "P1"), ("A", "B"), (0.7,), 1, models=("rrBLUP",), explained=("rrBLUP",))
    real, calls = study.run, []

    def dies(*args):
        calls.append(args[-1])
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(study, "run", dies)
    with pytest.raises(KeyboardInterrupt):
        study.run_resumable(spark, geno, pheno, asked, str(tmp_path / "sweep"), 1)
    first = [n for c in calls[:2] for n in c]
    again = study.run_resumable(spark, geno, pheno, asked, str(tmp_path / "sweep"), 3)
    assert len(calls) == 4 and not set(calls[3]) & set(first) and len(set(calls[3]) | set(first)) == 4
    one = real(spark, geno, pheno, asked)
    key = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    for table in ("predictions", "metrics", "effects"):
        a, b = getattr(again, table), getattr(one, table)
        assert key(a.select(*b.columns)) == key(b)
    assert len(calls) == 4 and study.run_resumable(spark, geno, pheno, asked, str(tmp_path / "sweep")).effects.count() == one.effects.count() and len(calls) == 4
