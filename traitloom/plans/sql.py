"""The study tables and steps as DuckDB SQL, to check the queries against."""

from __future__ import annotations

PARTS = {
    "geno": """
        SELECT vec_id AS id, concat('P', label % 5) AS population, pos, concat('m', lpad(CAST(pos AS VARCHAR), 2, '0')) AS marker,
               CASE WHEN x < -0.0555::DOUBLE THEN 0 WHEN x > 0.0557::DOUBLE THEN 2 ELSE 1 END AS dosage
        FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""",
    "traits": """
        SELECT id, population, sum(((pos * 37) % 11 - 5) * dosage * 10)
               + 50 * max(CASE WHEN pos = 3 THEN dosage ELSE 0 END) * max(CASE WHEN pos = 7 THEN dosage ELSE 0 END) AS dta,
               sum(((pos * 23) % 13 - 6) * dosage * 10) AS plh
        FROM geno GROUP BY id, population""",
    "pheno": """
        SELECT id, population, phenotype, CASE WHEN id % 17 = 0 THEN NULL ELSE CAST(s + (id * 7919) % 101 AS DOUBLE) / 100 END AS y
        FROM (SELECT id, population, 'DTA' AS phenotype, dta AS s FROM traits UNION ALL SELECT id, population, 'PLH', plh FROM traits)""",
    "usable": "SELECT * FROM pheno WHERE y IS NOT NULL AND id NOT IN (SELECT id FROM geno WHERE dosage IS NULL)",
    "scen": """
        SELECT concat_ws('|', population, phenotype, CAST(ratio AS VARCHAR), CAST(sample AS VARCHAR)) AS scenario_id, population, phenotype, ratio, sample
        FROM (VALUES ('P0'), ('P1'), ('P2'), ('P3'), ('P4')) p(population), (VALUES ('DTA'), ('PLH')) h(phenotype),
             (VALUES (0.8::DOUBLE), (0.5::DOUBLE)) r(ratio), (VALUES (1), (2)) s(sample)""",
    "split": """
        SELECT scenario_id, id, u.population, u.phenotype, ratio, sample, y,
               CASE WHEN row_number() OVER (PARTITION BY scenario_id ORDER BY md5(concat_ws(':', CAST(id AS VARCHAR), CAST(sample AS VARCHAR))), id)
                    <= floor(ratio * count(*) OVER (PARTITION BY scenario_id)) THEN 'train' ELSE 'test' END AS fold
        FROM usable u JOIN scen s ON u.population = s.population AND u.phenotype = s.phenotype""",
    "markers": """
        SELECT DISTINCT marker AS name, CAST(floor(pos / 8) AS INT) + 1 AS chromosome, (pos % 8) * 1000000 + 500 AS start,
               (pos % 8) * 1000000 + 5500 AS middle, (pos % 8) * 1000000 + 10500 AS "end"
        FROM geno WHERE pos < 63""",
    "chrom": "SELECT concat('chr', i) AS chromosome, 0 AS start, 6000000 AS \"end\" FROM range(1, 8) t(i)",
    "genes": """
        SELECT concat('chr', p_partkey % 8 + 1) AS chromosome, (p_partkey * 7919) % 8000000 AS start,
               (p_partkey * 7919) % 8000000 + p_size * 2000 AS "end", p_name AS name, p_brand AS class, p_partkey AS gene_id FROM part""",
    "lines": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag AS population,
               l_linestatus AS phenotype, 0.8::DOUBLE AS ratio, l_linenumber::INT AS sample, l_extendedprice::DOUBLE / 1000 AS actual,
               l_quantity::DOUBLE * 1.5 AS p1, l_quantity::DOUBLE * 1.4 + l_discount::DOUBLE AS p2,
               l_extendedprice::DOUBLE / 1000 * (1 - l_discount::DOUBLE) AS p3
        FROM lineitem""",
    "preds": """
        SELECT *, 'rrBLUP' AS model, p1 AS predicted FROM lines UNION ALL SELECT *, 'BayesB', p2 FROM lines UNION ALL SELECT *, 'RF', p3 FROM lines""",
    "scores": """
        SELECT population, phenotype, ratio, sample, model,
               covar_pop(actual, predicted) / nullif(stddev_pop(actual) * stddev_pop(predicted), 0) AS pearson,
               avg((actual - predicted) * (actual - predicted)) AS mse
        FROM preds GROUP BY ALL""",
    "mean_preds": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, population, phenotype, ratio, sample,
               any_value(actual) AS actual, any_value((p1 + p2 + p3) / 3) AS predicted
        FROM lines GROUP BY ALL""",
    "effects": """
        SELECT concat('P', event_id % 5) AS population, 'DTA' AS phenotype, event_type AS model,
               concat('m', lpad(CAST(user_id % 64 AS VARCHAR), 2, '0')) AS marker, event_id AS sample, value::DOUBLE - 50 AS effect
        FROM events""",
    "means": """
        SELECT population, phenotype, model, marker, round(avg(abs(effect)), 9) AS effect, CAST(grouping(population) AS TINYINT) AS overall
        FROM effects GROUP BY GROUPING SETS ((phenotype, model, marker), (population, phenotype, model, marker))""",
    "deciles": """
        SELECT overall, population, phenotype, model, quantile_cont(effect, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q
        FROM means GROUP BY ALL""",
    "bands": """
        SELECT m.*, CAST(1 + len(list_filter(q, lambda t: m.effect >= t)) AS INT) AS level,
               concat(CASE WHEN m.model = 'ensemble' THEN 'red' ELSE 'blue' END, 1 + len(list_filter(q, lambda t: m.effect >= t))) AS colour
        FROM means m JOIN deciles d ON m.overall = d.overall AND m.population IS NOT DISTINCT FROM d.population AND m.phenotype = d.phenotype AND m.model = d.model""",
    "located": """
        SELECT b.*, concat('chr', m.chromosome) AS chromosome, CAST(greatest(m.start - 100000, 0) AS BIGINT) AS start, CAST(m."end" + 100000 AS BIGINT) AS "end"
        FROM bands b JOIN markers m ON b.marker = m.name""",
    "pairs": """
        SELECT a.population, a.marker AS "from", b.marker AS "to", CAST(sum(a.dosage * b.dosage) AS DOUBLE) AS value
        FROM geno a JOIN geno b ON a.id = b.id AND a.pos < b.pos GROUP BY ALL""",
    "inter": """
        SELECT * FROM pairs UNION ALL SELECT population, "from", 'factor', value + 1000 FROM pairs WHERE "to" = 'm63'""",
    "inter_means": """
        SELECT population, "from", "to", avg(value) AS value FROM inter WHERE "from" <> 'factor' AND "to" <> 'factor' GROUP BY ALL""",
    "inter_cut": "SELECT population, quantile_cont(value, 0.98) AS cut FROM inter_means GROUP BY ALL",
    "inter_top": """
        SELECT i.population, "from", "to", value / sum(value) OVER (PARTITION BY i.population) AS value
        FROM inter_means i JOIN inter_cut c ON i.population = c.population WHERE value >= cut""",
}
USES = {
    "traits": ["geno"], "pheno": ["traits"], "usable": ["pheno", "geno"], "split": ["usable", "scen"], "markers": ["geno"], "preds": ["lines"],
    "scores": ["preds"], "mean_preds": ["lines"], "means": ["effects"], "deciles": ["means"], "bands": ["means", "deciles"], "located": ["bands", "markers"],
    "pairs": ["geno"], "inter": ["pairs"], "inter_means": ["inter"], "inter_cut": ["inter_means"], "inter_top": ["inter_means", "inter_cut"],
}


def with_parts(body: str, *names: str) -> str:
    """``body`` behind the named parts and all that they use."""
    order: list[str] = []

    def add(name):
        for n in USES.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in order) + "\n" + body
