"""Preparation of training sets: splits, labels, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardspark.operators.numbering import number_rows


#: Leading bits of the names' hashes that are counted at once to find the border of a split.
_BITS = 12


def split_dataset(df: DataFrame, name: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """df with `split`: exactly int(n * ratio) rows go to val, those with the smallest md5 of name and seed, then by name.

    Counts of the hashes' leading bits, at most 4096 on the driver, find the bits in which the border lies; only the rows
    that have them are sorted, over many tasks. Null names count as empty.
    """
    n = int(df.count() * ratio)
    hashed = F.md5(F.concat_ws("-", F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    keyed = df.withColumn("_h", hashed)
    lead = F.conv(F.substring("_h", 1, _BITS // 4), 16, 10).cast("int")
    below, border = 0, -1
    for r in sorted(keyed.groupBy(lead.alias("lead")).count().collect()):
        if below + r["count"] > n:
            border = r["lead"]
            break
        below += r["count"]
    rest = number_rows(keyed.filter(lead == border), [], [F.col("_h"), F.col(name)], "_n").withColumn("split", F.when(F.col("_n") <= n - below, "val").otherwise("train"))
    clear = keyed.filter(lead != border).withColumn("split", F.when((lead < border) | F.lit(border < 0), "val").otherwise("train"))
    return clear.select(*df.columns, "split").unionByName(rest.select(*df.columns, "split"))


def split_summary(df: DataFrame) -> DataFrame:
    """df: split, has_label."""
    return df.groupBy("split").agg(F.count("*").alias("images"), F.count_if("has_label").alias("labels"), F.round(F.count_if("has_label") / F.count("*"), 6).alias("ratio"))


def remap_classes(labels: DataFrame, source: int, target: int) -> DataFrame:
    return labels.filter(F.col("cls") == source).withColumn("cls", F.lit(target))


def relabel_summary(labels: DataFrame, source: int) -> DataFrame:
    return labels.groupBy("file").agg(F.count_if(F.col("cls") == source).alias("converted"), F.count_if(F.col("cls") != source).alias("removed"))


def missing_labels(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    return images.join(labels.select(key), key, "left_anti")


def continue_numbering(existing: DataFrame, new: DataFrame, order: str, prefix: str = "crop_") -> DataFrame:
    """new with file names that go on from the highest number of the existing names, in order within each group.

    existing: grp, name; new: grp and the order column.
    """
    top = existing.groupBy("grp").agg(F.max(F.try_to_number(F.nullif(F.regexp_extract("name", r"_(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long")).alias("_top"))
    numbered = number_rows(new, ["grp"], [F.col(order)], "_n").join(top, "grp", "left")
    return numbered.withColumn("name", F.format_string(f"{prefix}%06d", F.coalesce("_top", F.lit(0)) + F.col("_n"))).drop("_top", "_n")


def union_results(*tables: DataFrame) -> DataFrame:
    """The rows of all tables; a column that one lacks is null there."""
    out, *rest = tables
    for t in rest:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def attach_images(records: DataFrame, images: DataFrame) -> DataFrame:
    """records (batch, pos) with the image of the same batch and position (batch, images array)."""
    return records.join(images.select("batch", F.posexplode("images").alias("pos", "image")), ["batch", "pos"], "left")
