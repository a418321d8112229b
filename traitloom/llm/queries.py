"""One query for each corpus operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm import chattree, decontaminate, editprint, infill, kdshards, langid, linededup, resample, secretscan, sentencepiece, simhash, sitetext, toxicity
from traitloom.llm.common import table


def op1_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.edits_and_alike(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshards.assign(table(spark, sf_dir, "documents"))


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_classes(table(spark, sf_dir, "documents"), width=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece.tokenise(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("_pieces.token_ids").alias("n_tokens"),
        F.xxhash64("_pieces.token_ids").alias("ids_xxh64"),
        (F.col("_pieces.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
        "_pieces.parity",
    )


def op6_site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sitetext.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "_deleted.by_count", "_deleted.by_name")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "_deduped.n_lines", "_deduped.n_dropped", F.sha2("_deduped.text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "_language.lang_pred", "_language.score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = infill.restore(F.col("_infill.text"), F.col("_infill.form"))
    return out.select(
        "doc_id", "_infill.n", "_infill.form", "_infill.prefix_chars", "_infill.middle_chars",
        F.sha2("_infill.text", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    vocabulary = chattree.read_vocabulary()
    members, stream = chattree.format_conversations(convs, vocabulary)
    return members.join(chattree.read_back(stream, vocabulary), "at").drop("at")


QUERIES = {
    "op1_edit_fingerprint": op1_edit_fingerprint,
    "op2_secret_scan": op2_secret_scan,
    "op3_kd_shards": op3_kd_shards,
    "op4_simhash_vptree": op4_simhash_vptree,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_site_text": op6_site_text,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_chat_tree": op13_chat_tree,
}

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
            FROM documents
        ), keyed AS (
            SELECT doc_id, n, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), common AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        )
        SELECT k.doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE c.key IS NOT NULL AND c.keeper <> k.doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE c.key IS NULL OR c.keeper = k.doc_id), '')) AS kept_sha256
        FROM keyed k LEFT JOIN common c ON k.key = c.key
        GROUP BY k.doc_id
    """,
    "op9_decontamination": r"""
        WITH texts AS (
            SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
        ), split AS (
            SELECT kind, id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM texts
        ), shingles AS (
            SELECT DISTINCT kind, id, array_to_string(w[n : n + 4], ' ') AS shingle
            FROM (SELECT kind, id, w, unnest(range(1, greatest(2, len(w) - 3))) AS n FROM split WHERE len(w) > 0)
        ), sizes AS (
            SELECT id, count(*) AS n_shingles FROM shingles WHERE kind = 'i' GROUP BY id
        ), met AS (
            SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found
            FROM shingles d JOIN shingles i ON d.shingle = i.shingle WHERE d.kind = 'd' AND i.kind = 'i'
            GROUP BY d.id, i.id
        )
        SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles, CAST(n_found AS INTEGER) AS n_found,
               CAST(n_found AS DOUBLE) / n_shingles AS containment
        FROM met JOIN sizes ON item_id = id WHERE n_found >= 0.8 * n_shingles
    """,
    "op11_fill_in_middle": r"""
        WITH named AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
            FROM documents
        ), drawn AS (
            SELECT *, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50
                        THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM named
        ), cut AS (
            SELECT doc_id, text, n, form, array_to_string(t[1 : least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1 : greatest(a, b)], '') AS m,
                   array_to_string(t[greatest(a, b) + 1 : n], '') AS s
            FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM cut
    """,
    "op13_chat_tree": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), escaped AS (
            SELECT *, regexp_replace(regexp_replace(text, '(</?\\*)(s>)', '\1\\\2', 'g'), '(\[/?\\*)(INST\])', '\1\\\2', 'g') AS e FROM turns
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(e) + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
}
