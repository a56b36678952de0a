"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardspark.llm import byte_bpe, decontaminate, html_text, jaccard_join, language_id, license_scan, line_dedup, mtree, packing, resample, token_count, toxicity, whitening
from yardspark.llm._staging import spread


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole table, dealt over the cores for operators that work row by row."""
    return spread(_table(spark, sf_dir, "documents").select(*columns))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return license_scan.scan_licences(docs).select("doc_id", "sentence_ids", "licences", "n_unmatched", "n_unknown")


def _op1_sql() -> str:
    """The same sentences and rules as DuckDB expressions."""
    denied = f" AND NOT regexp_matches(s, '{license_scan.DENIED}')"
    cases = " ".join(f"WHEN regexp_matches(s, '{p}'){denied if name in license_scan.NAMING else ''} THEN '{name}'" for name, p in license_scan.SENTENCES)
    seq = "coalesce(string_agg('|' || id || '|', '' ORDER BY pos), '')"
    for licence, ids in license_scan.RULES:
        seq = f"replace({seq}, '{''.join(f'|{x}|' for x in ids)}', '|#{licence}|')"
    return rf"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
cut AS (SELECT r, unnest(string_split(regexp_replace(lower(text), '[.!?;:]+([ \t\r\n]|$)|\n', chr(1), 'g'), chr(1))) AS raw,
               generate_subscripts(string_split(regexp_replace(lower(text), '[.!?;:]+([ \t\r\n]|$)|\n', chr(1), 'g'), chr(1)), 1) AS pos
        FROM rows_),
named AS (SELECT r, pos, CASE {cases} ELSE 'unknown' END AS id
          FROM (SELECT r, pos, trim(regexp_replace(raw, '[^a-z0-9.]+', ' ', 'g')) AS s FROM cut WHERE regexp_matches(raw, '{license_scan.CUES}'))),
seqs AS (SELECT r, coalesce(string_agg(id, ',' ORDER BY pos), '') AS sentence_ids, {seq} AS seq, count(*) FILTER (id = 'unknown') AS n_unknown FROM named GROUP BY r),
parts AS (SELECT r, sentence_ids, n_unknown, list_filter(string_split(seq, '|'), lambda x: x <> '') AS p FROM seqs)
SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids,
       coalesce(array_to_string(list_transform(list_filter(p, lambda x: x[1] = '#'), lambda x: x[2:]), ','), '') AS licences,
       coalesce(len(list_filter(p, lambda x: x[1] <> '#' AND x <> 'unknown')), 0) AS n_unmatched, coalesce(n_unknown, 0) AS n_unknown
FROM rows_ LEFT JOIN parts USING (r)
"""


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(_documents(spark, sf_dir, "doc_id", "text"), k=4, num=85, den=100)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    profiles = language_id.learn_profiles(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return token_count.count_tokens(docs, _vocabulary("word_bpe_49k.json"), limit=2048).drop("text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, hot.k IS NOT NULL AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, vocabulary = _documents(spark, sf_dir, "doc_id", "text"), _vocabulary("byte_bpe_multi_50k.tiktoken")
    both = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir, "doc_id", "text")
    return packing.pack_documents(docs, _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, capacity=2048)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    drawn = resample.resample(docs, _table(spark, sf_dir, "benchmark"), most=1, buckets=10_000, percent=10, least_words=20, seed="2024")
    return drawn.drop("n_words")


# crc32 by its table of 256 entries, which SQL derives from the polynomial, once for each distinct word
OP11_SQL = r"""
WITH t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
rows_ AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
dw AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM rows_),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
b AS (SELECT w, list_transform(range(len(x) // 2), lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b FROM x),
k AS (SELECT w, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM b, t),
s AS (SELECT k, count(*) AS s FROM dw JOIN k USING (w) GROUP BY k), tt AS (SELECT k, count(*) AS t FROM bw JOIN k USING (w) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
g AS (SELECT i AS k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM range(10000) r(i) CROSS JOIN n LEFT JOIN s ON s.k = i LEFT JOIN tt ON tt.k = i),
d AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN k USING (w) JOIN g USING (k) GROUP BY r),
h AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('2024:' || doc_id)[i]) - 1), lambda a, v: 16 * a + v, 0::BIGINT) AS h
      FROM rows_ LEFT JOIN d USING (r)),
c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM o
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"), scale=64, offset=1_000_000, most=16)
    parts = F.posexplode(F.arrays_zip(F.col("z").alias("whitened"), F.col("explained").alias("explained"))).alias("at", "c")
    rows = white.select("vec_id", "n", "deviation", "identity_error", parts)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_decontamination": op3_decontamination,
        "op4_topk_search": op4_topk_search,
        "op5_language_id": op5_language_id,
        "op6_token_counts": op6_token_counts,
        "op7_line_dedup": op7_line_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_html_extraction": op13_html_extraction,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op4_topk_search": OP4_SQL, "op7_line_dedup": OP7_SQL, "op11_importance_resampling": OP11_SQL}
