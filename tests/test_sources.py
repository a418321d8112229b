import numpy as np

from traitloom import sources


def test_wide_table(spark, tmp_path):
    (tmp_path / "g.csv").write_text("ID,Population,m.1,m2,trait A\na,P0,0,2,1.5\nb,P1,,x,\n")
    geno, pheno = sources.read_wide(spark, str(tmp_path / "g.csv"), 1)
    assert sorted((r.id, r.marker, r.pos, r.dosage) for r in geno.collect()) == [("a", "m.1", 0, 0.0), ("a", "m2", 1, 2.0), ("b", "m.1", 0, None), ("b", "m2", 1, None)]
    assert [(r.id, r.population, r.phenotype, r.y) for r in pheno.orderBy("id").collect()] == [("a", "P0", "trait A", 1.5), ("b", "P1", "trait A", None)]


def test_odd_lines_of_a_wide_table(spark, tmp_path):
    """Quotes, dirty cells, short and long lines, repeated headers, several files, and no lines at all."""
    head = 'ID,Population,"m,1",m2,m2,T\n'
    (tmp_path / "a.csv").write_text("\ufeff" + head + '"a ""b""",P0, 1 ,2,NaN,x\n\nshort,P0,1\nlong,P1,0,1,2,3.5,9,9\n' + "\ufeff" + head)
    geno, pheno = sources.read_wide(spark, str(tmp_path / "a.csv"), 1)
    assert sorted((r.id, r.marker, r.pos, r.dosage) for r in geno.collect()) == [
        ('a "b"', "m,1", 0, 1.0), ('a "b"', "m2", 1, 2.0), ('a "b"', "m2", 2, None),
        ("long", "m,1", 0, 0.0), ("long", "m2", 1, 1.0), ("long", "m2", 2, 2.0),
        ("short", "m,1", 0, 1.0), ("short", "m2", 1, None), ("short", "m2", 2, None),
    ]
    assert sorted((r.id, r.population, r.phenotype, r.y) for r in pheno.collect()) == [('a "b"', "P0", "T", None), ("long", "P1", "T", 3.5), ("short", "P0", "T", None)]
    many = tmp_path / "many"
    many.mkdir()
    for n in range(3):
        (many / f"{n}.csv").write_text(f"ID,Population,m1,T\n{n},P0,{n},1\n,,2,\n")
    geno, _ = sources.read_wide(spark, str(many), 1)
    assert sorted(((r.id, r.dosage) for r in geno.collect()), key=str) == sorted([("0", 0.0), ("1", 1.0), ("2", 2.0), *[(None, 2.0)] * 3], key=str)
    (tmp_path / "empty.csv").write_text("ID,Population,m1,T\n")
    assert [x.count() for x in sources.read_wide(spark, str(tmp_path / "empty.csv"), 1)] == [0, 0]


def test_a_hundred_thousand_markers_under_one_plan(spark, tmp_path):
    """The plan does not grow with the columns, and the vectors come out whole."""
    plans = []
    for p in (10, 100_000):
        x = np.random.default_rng(p).integers(0, 3, (6, p))
        path = tmp_path / f"g{p % 7}.csv"
        with path.open("w") as f:
            f.write("ID,Population," + ",".join(f"m{k}" for k in range(p)) + ",T\n")
            f.writelines(f"i{n},P0," + ",".join(map(str, row)) + f",{n}\n" for n, row in enumerate(x))
        table = sources.WideTable(spark, str(path), 1)
        plans.append(len(table.genotypes()._jdf.queryExecution().toString()))
        rows = sorted(table.vectors().collect())
        assert [r.id for r in rows] == [f"i{n}" for n in range(6)] and (np.array([r.x for r in rows]) == x).all()
        cells = table.genotypes().groupBy("id").agg({"dosage": "sum", "pos": "max", "marker": "max"}).collect()
        assert {r.id: (r["sum(dosage)"], r["max(pos)"]) for r in cells} == {f"i{n}": (x[n].sum(), p - 1) for n in range(6)}
        assert [r.y for r in table.phenotypes().orderBy("id").collect()] == [0, 1, 2, 3, 4, 5]
    assert abs(plans[0] - plans[1]) < 200  # numbers of expressions differ in length


def test_regions_and_chromosomes(spark, tmp_path):
    (tmp_path / "chrom.bed").write_text("Chromosome\tStart\tEnd\nchr1\t0\t100\nchr2\t0\t50 ")
    (tmp_path / "chrom_W1.bed").write_text("Chromosome\t0\tLocation\nchr1\t0\t90 \n")
    (tmp_path / "QTL.tsv").write_text("Chromosome\tstart\tend\tName\tpheno\nchr1\t5\t9\tq1\tacen\n")
    (tmp_path / "QTL_W1.tsv").write_text("Chromosome\tstart\tend\tZmGene\tdays\nchr2\t1\t2\tq2\tclock\n")
    got = sources.read_chromosomes(spark, str(tmp_path / "chrom*.bed"))
    assert sorted((r.population or "", r.chromosome, r.end) for r in got.collect()) == [("", "chr1", 100), ("", "chr2", 50), ("W1", "chr1", 90)]
    known = sources.read_regions(spark, str(tmp_path / "QTL*.tsv"), "QTL")
    assert sorted((r.population or "", r.name, r["class"], r.gene_set) for r in known.collect()) == [("", "q1", "acen", "QTL"), ("W1", "q2", "clock", "QTL")]
    (tmp_path / "info.csv").write_text("name,chromosome,start,middle,end\nm1,3,1,2,3\n")
    assert sources.read_markers(spark, str(tmp_path / "info.csv")).first().chromosome == 3


def test_sinks(spark, tmp_path):
    kind = "population string, phenotype string, ratio double, sample int, id long, fold string, model string, actual double, predicted double"
    frame = spark.createDataFrame([("P", "T", 0.8, 1, 7, "test", m, 1.0, v) for m, v in (("RF", 2.0), ("SVR", 3.0))] + [("P", "T", 0.8, 1, 8, "train", "RF", 1.0, 5.0)], kind)
    wide = sources.wide_predictions(frame, ["RF", "SVR", "MLP"], "test").collect()
    assert len(wide) == 1 and (wide[0].RF, wide[0].SVR, wide[0].MLP, wide[0].actual) == (2.0, 3.0, None, 1.0)
    assert sources.write_table(frame, str(tmp_path / "t"), "parquet", ["model", "phenotype"], skip_empty=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert not sources.write_table(frame.limit(0), str(tmp_path / "none"), skip_empty=True) and not (tmp_path / "none").exists()
    sources.write_table(frame.drop("model"), str(tmp_path / "bands"), "tsv", ["population"])
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "bands"))
    assert back.count() == 3 and {r.population for r in back.collect()} == {"P"}
