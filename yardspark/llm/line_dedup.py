"""Line deduplication with DataFrame functions only: lines found in many documents lose every occurrence.

Every row is one document, also where its id repeats or is null. A null text counts as empty, which is one empty line.
An empty table gives an empty one.
A line's key is the line without space and 0x09-0x0D at both ends, with A-Z lower-cased. Keys are compared by
two 64-bit hashes. Ties cannot occur. Other columns are untouched; a column named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardspark.llm._staging import Staging, fresh

#: Common lines that are broadcast at most (16 bytes each).
BROADCAST_LINES = 1 << 17
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_ENDS))
    plain = F.octet_length(bare) == F.char_length(bare)  # ASCII alone: lower() changes A-Z only, and is faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _SMALL))


def _hashes(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def common_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(h, g, n_docs): hashes of the keys of at least min_chars code points found in at least min_docs documents.

    A document's distinct keys are found within its row, so that one shuffle of partial counts is enough.
    """
    keys = F.transform(F.filter(_lines(F.col(text)), lambda x: F.char_length(F.btrim(x, F.lit(_ENDS))) >= min_chars), _hashes)
    each = docs.select(F.explode(F.array_distinct(keys)).alias("k")).select("k.h", "k.g")
    return each.groupBy("h", "g").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def _heavy(hot: DataFrame, most: int) -> int:
    """The least power of two of documents from which at most `most` lines are found in so many."""
    left = most
    for power, n in sorted(((r[0], r[1]) for r in hot.groupBy(F.floor(F.log2("n_docs")).alias("p")).count().collect()), reverse=True):
        left -= n
        if left < 0:
            return 1 << (power + 1)
    return 0


def drop_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, most: int = BROADCAST_LINES) -> DataFrame:
    """docs with `text` rebuilt from the lines that stay, in their order, plus n_lines and n_dropped.

    The common lines of the most documents, at most `most` of them, are broadcast to find their hits, so that a line of
    very many documents does not meet in one task; hits of the others, if there are more, meet them in a join. The hits
    (few bytes for each) meet their documents by id; the documents' texts are shuffled once and not sorted.
    """
    lines_, kept_, hot_, key_ = fresh(docs, "lines", "kept", "hot", "key")
    stage = Staging(docs.sparkSession, "line_dedup")
    hot = stage.put(common_lines(docs, text, min_docs, min_chars), "hot")
    least = _heavy(hot, most)
    hits = docs.select(F.col(doc_id).alias(key_), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _hashes))).alias("k"))
    hits = hits.select(key_, "k.h", "k.g")
    found = hits.join(F.broadcast(hot.filter(F.col("n_docs") >= least).select("h", "g")), ["h", "g"], "left_semi")
    if least:
        found = found.unionByName(hits.join(hot.filter(F.col("n_docs") < least).select("h", "g").hint("merge"), ["h", "g"], "left_semi"))
    marks = found.groupBy(key_).agg(F.collect_set(F.struct("h", "g")).alias(hot_))
    out = docs.drop("n_lines", "n_dropped")
    out = out.join(marks.hint("shuffle_hash"), out[doc_id].eqNullSafe(marks[key_]), "left").drop(key_)
    out = out.withColumn(lines_, _lines(F.col(text)))
    kept = F.when(F.col(hot_).isNull(), F.col(lines_)).otherwise(F.filter(lines_, lambda x: ~F.array_contains(F.col(hot_), _hashes(x))))
    out = out.withColumn(kept_, kept)
    sizes = {"n_lines": F.size(lines_).cast("long"), "n_dropped": (F.size(lines_) - F.size(kept_)).cast("long")}
    return out.withColumns(sizes | {text: F.array_join(kept_, "\n")}).drop(lines_, kept_, hot_)
