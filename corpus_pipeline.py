"""A corpus pipeline over `documents`: language, common lines, near copies, benchmark leaks, tokens.

STAGES holds (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents (COLUMNS);
further columns are left out. Null and empty texts and texts without a letter go in the first stage. Rows with null or
repeated ids are judged by their texts: of equal rows one stays. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardspark.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from yardspark.llm._staging import Staging

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Likeness to the nearest profile under which a text is no language; words of any learned language reach far more.
LEAST_SCORE = 0.01


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts of a learned language; `lang` becomes the predicted one."""
    profiles = language_id.learn_profiles(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs.select(COLUMNS), profiles)
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that 10 or more documents share; `n_chars` follows the text."""
    kept = line_dedup.drop_common_lines(docs.select(COLUMNS), min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 stays: the one with the smallest id, null last.

    Rows are told apart by their place in the stage's files, so that a repeated or null id does not matter.
    """
    rows = docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id())
    found = jaccard_join.near_components(rows, k=5, num=80, den=100, doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
    member = rows.select("row", "doc_id").join(found, "row")
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    groups = member.groupBy("component_id").agg(first, F.count("*").alias("n")).filter("n > 1").select("component_id", "first")
    copies = member.join(groups, "component_id").filter(F.col("row") != F.col("first")).select("row")
    return rows.join(copies, "row", "left_anti").select(COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go; each row is judged by its own text."""
    return decontaminate.clean_documents(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left with their token ids as little-endian unsigned 32-bit integers."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, public_tokenizers.PATTERN, keep_text=False)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("byte-level BPE", tokens),
]
#: SQL cannot express rank-order profiles, alignment and merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    stage = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage.put(docs, f"stage{i}")
    return docs
