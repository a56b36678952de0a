"""Rules over text readings: cleaning, rejects, scores and votes, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardspark.functions.text import nz

#: Strings that make a reading garbage where contained, and where equal.
GARBAGE_IN = ["JBHUNT", "JBHUN", "JBHUNTAD", "BHUNT", "APPS", "APPST", "APPSI", "WVAN", "ZIES", "NH8T", "IBUNF", "JSDV"]
GARBAGE_IS = ["WI", "PR", "IL", "QT", "LOU", "MME", "PZ", "F1", "L1"]
#: More strings that make a detector's candidate garbage where contained: misread signs, and fragments of names.
MISREAD = ["360BX", "36CBOX", "36CBX", "36COX", "36C6X", "36C60X", "36CB0X"]
FRAGMENTS = ["ZAYLAN", "ZAY", "AYLAN", "ZANZ", "ZIAZ", "IAZIA"]
#: What text models put in front of an answer, tried in this order, roles that stand on lines of their own,
#: and separators of which the first found ends an explanation in answers of more than LONG_ANSWER signs.
ANSWERS = ["The text in the image is:", "The text is:", "Text:", "Content:", "The image contains:", "The image shows:", "I can see:"]
ROLES = ["assistant", "user"]
SEPARATORS, LONG_ANSWER = ["\n\n", "\n", ". ", "。", "："], 500
#: A known invented answer, and company names from the first tried.
HALLUCINATION = "JBHU342345"
COMPANIES = ["J.B.HUNT", "JBHUNT", "JBHU", "J.B.HUNTA"]


def letters(t: Column) -> Column:
    return t.rlike(r"\p{L}")


def digits(t: Column) -> Column:
    return t.rlike(r"[0-9]")


def alnum(t: Column) -> Column:
    return F.regexp_replace(t, r"[^\p{L}\p{N}]", "")


def signs(t: Column) -> Column:
    """The signs of a text as an array."""
    return F.filter(F.split(t, ""), lambda c: c != "")


def noise_reason(text: Column) -> Column:
    """Why a reading is noise: empty, none, hallucination, repeated, few_signs; null if it is not."""
    t = F.coalesce(nz(text), F.lit(""))
    body = alnum(t)
    n, kinds = F.char_length(t), F.array_distinct(signs(body))
    most = F.array_max(F.transform(kinds, lambda c: F.size(F.filter(signs(body), lambda x: x == c))))
    few = F.size(kinds)
    return (
        F.when(n < 1, "empty").when(F.upper(t) == "NONE", "none").when(F.replace(F.upper(t), F.lit(" ")) == HALLUCINATION, "hallucination")
        .when((n >= 60) & (F.char_length(body) > 30) & (most / F.char_length(body) > 0.75), "repeated")
        .when((n > 120) & (few < 3) | (n > 80) & (n <= 120) & (few < 5), "few_signs")
    )


def reject_noise(readings: DataFrame, text: str = "text") -> DataFrame:
    return readings.withColumn("reject_reason", noise_reason(F.col(text)))


def clean_single(text: Column) -> Column:
    """Letters, digits, blanks, - and _ with single blanks; without a blank letters and digits alone, unless none is left."""
    kept = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", ""), " +", " "))
    return F.when(kept.contains(" "), kept).otherwise(F.coalesce(F.nullif(alnum(kept), F.lit("")), kept))


def clean_full(text: Column) -> Column:
    """A whole image's words, each once by its upper-case letters and digits, without words of two signs or fewer that hold no digit."""
    words = F.filter(F.split(text, r"\s+"), lambda w: alnum(w) != "")
    once = F.filter(words, lambda w, i: ~F.exists(F.slice(words, F.lit(1), i), lambda v: F.upper(alnum(v)) == F.upper(alnum(w))))
    return F.array_join(F.filter(once, lambda w: (F.char_length(alnum(w)) > 2) | digits(alnum(w))), " ")


def reorder_digits(text: Column, least: int = 2, most: int = 15) -> Column:
    """Two or three fragments of digits joined to the best candidate: a single digit in front is preferred."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    joined = F.array_join(parts, "")
    usable = F.size(parts).between(2, 3) & F.forall(parts, lambda w: w.rlike("^[0-9]+$")) & F.char_length(joined).between(least, most)
    ones, more = F.filter(parts, lambda w: F.char_length(w) == 1), F.filter(parts, lambda w: F.char_length(w) > 1)
    single, multi = F.get(ones, F.lit(0)), F.array_join(more, "")
    mixed = (F.size(ones) > 0) & (F.size(more) > 0)
    candidates = F.when(mixed, F.array(F.concat(single, multi), F.concat(multi, single), joined)).otherwise(F.array(joined))
    length = lambda c: F.char_length(c)
    score = lambda c: F.when(length(c).between(3, 6), 10).when(length(c) == 2, 5).when(length(c).between(7, 8), 8).otherwise(3) + F.when((F.size(ones) > 0) & c.startswith(single), 2).otherwise(0)
    fitting = F.filter(candidates, lambda c: length(c).between(least, most))
    best = F.array_min(F.transform(fitting, lambda c, i: F.struct((-score(c)).alias("s"), i.alias("i"), c.alias("c"))))["c"]
    return F.when(usable, F.coalesce(best, text)).otherwise(text)


def pattern_confidence(t: Column) -> Column:
    return F.when(letters(t) & digits(t), 0.85).when(t.rlike("^[0-9]+$"), 0.80).when(letters(t), 0.70).otherwise(0.50)


def holds(t: Column, listed: list[str]) -> Column:
    """Whether the upper-case text contains one of the strings."""
    up = F.upper(t)
    return F.exists(F.array(*map(F.lit, listed)), lambda g: up.contains(g))


def is_garbage(t: Column) -> Column:
    """Whether a reading holds one of the garbage strings or is one of the short ones."""
    return holds(t, GARBAGE_IN) | F.upper(t).isin(*GARBAGE_IS)


def dedupe_phrases(text: Column) -> Column:
    """Equal words in a row once, then pairs of words that were seen already are left out."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    once = F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("skip"))

    def step(a: Column, x: Column) -> Column:
        last = F.size(a["out"])
        pair = F.concat_ws(" ", x["w"], x["next"])
        drop = (last >= 1) & x["next"].isNotNull() & F.array_contains(a["seen"], pair)
        out = F.concat(a["out"], F.array(x["w"]))
        seen = F.when(last >= 1, F.concat(a["seen"], F.array(F.concat_ws(" ", F.get(a["out"], last - 1), x["w"])))).otherwise(a["seen"])
        same = lambda skip: F.struct(a["out"].alias("out"), a["seen"].alias("seen"), skip.alias("skip"))
        return F.when(a["skip"] > 0, same(F.lit(0))).when(drop, same(F.lit(1))).otherwise(F.struct(out.alias("out"), seen.alias("seen"), F.lit(0).alias("skip")))

    pairs = F.transform(once, lambda w, i: F.struct(w.alias("w"), F.get(once, i + 1).alias("next")))
    return F.array_join(F.aggregate(pairs, start, step)["out"], " ")


def valid_id(t: Column, conf: Column, least: int = 2, most: int = 15) -> Column:
    """The last test: digits alone, letters and digits, or letters with a confidence of 0.70; all within the lengths."""
    n = F.char_length(t).between(least, most)
    return n & (t.rlike("^[0-9]+$") | letters(t) & digits(t) | letters(t) & ~digits(t) & (conf >= 0.70))


def reject_short(t: Column, conf: Column) -> Column:
    """A cut reading, blank where too short or too unsure: a single sign must be a digit with 0.25."""
    s = F.coalesce(nz(t), F.lit(""))
    good = (conf >= 0.15) & ((F.char_length(s) >= 2) | s.rlike("^[0-9]$") & (conf >= 0.25))
    return F.when(good, s).otherwise("")


def candidate_score(text: Column, conf: Column, relative_area: Column, centre_distance: Column, least: int = 2, most: int = 15) -> Column:
    """The score of a candidate by area, length, kinds of signs and place; null where it is rejected."""
    t = alnum(text)
    n = F.char_length(t)
    bad = ~n.between(least, most) | holds(t, GARBAGE_IN + GARBAGE_IS + MISREAD + FRAGMENTS) | (n == 2) & ~(t.rlike("^[0-9]+$") & (conf > 0.8)) | (n <= 3) & t.rlike(r"^\p{L}+$") & (conf < 0.9)
    by_area = F.when(relative_area.between(0.01, 0.5), 1.2).when(relative_area < 0.01, 0.7).otherwise(0.5)
    by_length = F.when(n.between(3, 12), 1.3).when((n == 2) | n.between(13, 15), 1.1).otherwise(1.0)
    by_signs = F.when(letters(t) & digits(t), 1.2).when(digits(t), 1.1).otherwise(1.0)
    return F.when(~bad, conf * by_area * by_length * by_signs * F.when(centre_distance < 0.3, 1.1).otherwise(1.0))


def strip_preamble(text: Column) -> Column:
    """An answer without what stands up to the first known prefix, role lines and empty lines; other lines joined by blanks.

    Of a long answer the part behind the last separator of the first kind found counts. A text of a role alone is blank.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    cut = text
    for prefix in reversed(ANSWERS):
        at = F.instr(F.lower(text), prefix.lower())
        cut = F.when(at > 0, bare(F.substr(text, at + len(prefix)))).otherwise(cut)
    last = cut
    for sign in reversed(SEPARATORS):
        last = F.when(cut.contains(sign), bare(F.substring_index(cut, sign, -1))).otherwise(last)
    body = F.when(F.char_length(cut) > LONG_ANSWER, last).otherwise(cut)
    lines = F.filter(F.transform(F.split(body, "\n"), bare), lambda x: (x != "") & ~F.lower(x).isin(*ROLES))
    alone = body
    for role in reversed(ROLES):
        alone = F.when(F.lower(body).startswith(role), F.regexp_replace(F.substr(body, F.lit(len(role) + 1)), r"^[:\n\r\t ]+", "")).otherwise(alone)
    return bare(F.when(F.size(lines) > 0, F.array_join(lines, " ")).otherwise(alone))


def match_readings(crops: DataFrame, readings: DataFrame) -> DataFrame:
    """crops with their reading by crop_filename; without one the text is blank and the method not_found."""
    right = readings.select("crop_filename", F.col("text").alias("_t"), F.col("conf").alias("_c"), F.col("method").alias("_m"))
    out = crops.join(right, "crop_filename", "left")
    return out.withColumns({"ocr_text": F.coalesce("_t", F.lit("")), "ocr_conf": F.coalesce("_c", F.lit(0.0)), "ocr_method": F.coalesce("_m", F.lit("not_found")), "spot": F.coalesce("spot", F.lit("unknown"))}).drop("_t", "_c", "_m")


def text_quality(t: Column) -> Column:
    odd = F.char_length(F.regexp_replace(t, r"[\p{L}\p{N} .-]", ""))
    kind = F.when(letters(t) & digits(t), 5.0).when(letters(t), 2.0).when(digits(t), 1.0).otherwise(0.0)
    return F.least(F.char_length(t), F.lit(20)) * F.lit(0.1) + kind - odd * F.lit(0.5)


def _looks_valid(t: Column) -> Column:
    n = F.char_length(t)
    return (n >= 2) & (letters(t) & (digits(t) | (n >= 4)) | digits(t) & (n >= 4) & ~letters(t))


def consolidate_readings(readings: DataFrame, key: str = "track", order: str = "event_id") -> DataFrame:
    """One text for each track by votes: count times (1 + mean confidence) plus quality; a company name joined with the
    best number of 4 to 8 digits wins where it scores higher. A track whose readings are all blank gets a blank.

    Votes are counted by (track, text) first, so that a track's readings meet as few rows as it has texts.
    """
    base = readings.withColumn("_t", nz("text"))
    totals = base.groupBy(key).agg(F.count("*").alias("total"), F.min(order).alias("first_seen"))
    votes = base.filter("_t is not null").groupBy(key, F.col("_t").alias("t")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.min(order).alias("o"))
    score = F.col("n") * (1 + F.col("c")) + F.when(_looks_valid(F.col("t")), text_quality(F.col("t")) * 2).otherwise(-2.0)
    company = F.coalesce(*[F.when(F.upper("t").contains(p), F.lit(p)) for p in COMPANIES])
    votes = votes.withColumns({"s": score, "company": company, "num": F.explode_outer(_numbers(F.col("t"), F.col("n"), F.col("c")))})
    k = F.col("num.n") * (1 + F.col("num.c"))
    length = F.char_length("num.d")
    ns = k * F.when(length == 6, 1.5).when(length.isin(5, 7), 1.2).when(length.isin(4, 8), 1.1).otherwise(1.0)
    best = votes.groupBy(key).agg(
        F.min_by(F.struct("t", "c", "s"), F.struct(-F.col("s"), "o")).alias("b"), F.countDistinct("t").alias("texts"),
        F.min_by(F.when(F.col("company").isNotNull(), F.struct("company", "n", "c")), F.when(F.col("company").isNotNull(), F.struct(-F.col("n") * (1 + F.col("c")), "o"))).alias("k"),
        F.min_by(F.when(F.col("num").isNotNull(), F.col("num")), F.when(F.col("num").isNotNull(), F.struct(-ns, F.col("o"), F.col("num.p")))).alias("d"),
    )
    joint = F.when(F.col("k").isNotNull() & F.char_length("d.d").between(4, 8), F.concat_ws(" ", "k.company", "d.d"))
    mean = (F.col("k.c") + F.col("d.c")) / 2
    joint_score = (F.col("k.n") + F.col("d.n")) * (1 + mean) + text_quality(joint) * 5
    wins = F.coalesce(joint_score > F.col("b.s"), F.lit(False))
    out = totals.join(best, key, "left")
    return out.select(key, F.coalesce(F.when(wins, joint).otherwise(F.col("b.t")), F.lit("")).alias("text"), F.coalesce(F.when(wins, mean).otherwise(F.col("b.c")), F.lit(0.0)).alias("conf"), "first_seen", "total", F.coalesce("texts", F.lit(0)).alias("texts"))


def _numbers(t: Column, n: Column, c: Column) -> Column:
    """Candidates (digits, count, confidence, position) of a text: runs of 3 to 8 digits, and digits joined over breaks."""
    runs = F.regexp_extract_all(t, F.lit(r"(\d+)"))
    item = lambda d, f, p: F.struct(d.alias("d"), n.alias("n"), (c * f).alias("c"), p.alias("p"))
    plain = F.transform(F.filter(runs, lambda d: F.char_length(d).between(3, 8)), lambda d, i: item(d, F.when(F.char_length(d) == 3, 0.7).otherwise(1.0), i))
    joined, broken = F.array_join(runs, ""), t.contains("-") | (F.size(runs) > 1)
    size = F.char_length(joined)
    nothing = F.filter(plain, lambda x: F.lit(False))
    whole = F.when(broken & size.between(4, 8) & (n >= 2), F.array(item(joined, F.lit(0.85), F.lit(100)))).otherwise(nothing)
    sliding = F.when(broken & (size > 8), F.transform(F.sequence(F.lit(1), F.greatest(size - 5, F.lit(1))), lambda i: item(F.substring(joined, i, F.lit(6)), F.lit(0.8), 200 + i))).otherwise(nothing)
    return F.concat(plain, whole, sliding)


def best_reading(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """Per image the best of several attempts (text, conf, method), the first of equal ones."""
    t = nz("text")
    n = F.char_length(t)
    kinds = F.when(letters(t) & digits(t), 1.2).when(digits(t), 1.1).when(letters(t) & (n >= 4), 1.05).otherwise(1.0)
    lengths = F.when(n.between(3, 12), 1.15).when(n.between(4, 15), 1.08).otherwise(1.0)
    rotated = F.when(F.lower("method").contains("rotated"), 1.15).otherwise(1.0)
    rows = attempts.filter(t.isNotNull() & (F.col("conf") >= 0.01)).withColumn("score", F.col("conf") * kinds * lengths * rotated)
    best = rows.groupBy(key).agg(F.min_by(F.struct(t.alias("text"), "conf", "method", "score"), F.struct(-F.col("score"), order)).alias("b"))
    out = attempts.select(key).distinct().join(best, key, "left")
    return out.select(key, F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.conf", F.lit(0.0)).alias("conf"), F.coalesce("b.method", F.lit("none")).alias("method"))


def merge_readings(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """Per image the words of all attempts, each once by its upper-case letters and digits in its first spelling."""
    words = attempts.select(key, order, "conf", F.posexplode(F.split("text", r"\s+")).alias("_i", "_w")).withColumn("_k", F.upper(alnum(F.col("_w")))).filter("_k <> ''")
    first = words.groupBy(key, "_k").agg(F.min(F.struct(order, "_i", "_w", "conf")).alias("f"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["_w"]), " ").alias("text"), F.avg("f.conf").alias("conf"))


def _ranked(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """Per image its candidates (t, c, s) from the best score on; they are as few as an image has texts."""
    item = F.struct((-F.col("score")).alias("n"), F.col(order).alias("o"), F.col("text").alias("t"), F.col("conf").alias("c"), F.col("score").alias("s"))
    return candidates.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_all"))


def _apart(items: Column, most: int) -> Column:
    """Of items in order the first `most` whose texts neither hold a kept text nor are held by one."""
    none = F.filter(items, lambda x: F.lit(False))
    held = lambda acc, x: F.exists(acc, lambda y: y["t"].contains(x["t"]) | x["t"].contains(y["t"]))
    return F.aggregate(items, none, lambda acc, x: F.when((F.size(acc) >= most) | held(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def _mean(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x["c"]) / F.size(items)


def distinct_ids(candidates: DataFrame, key: str, order: str, least: int = 2, most: int = 15, top: int = 10) -> DataFrame:
    """Per image its distinct ids (ids, conf) from the best score on: 3 to 8 digits, or 4 to 12 letters and digits,
    without garbage, sure enough, and neither holding nor held by an id that is kept already."""

    def good(x: Column) -> Column:
        n, mixed = F.char_length(x["t"]), letters(x["t"]) & digits(x["t"])
        shape = x["t"].rlike("^[0-9]+$") & n.between(3, 8) | mixed & n.between(4, 12)
        return shape & n.between(least, most) & ~holds(x["t"], GARBAGE_IN + GARBAGE_IS + MISREAD) & (x["s"] > 0.5) & (x["c"] > 0.6)

    held = _ranked(candidates, key, order).withColumn("_k", _apart(F.filter("_all", good), top)).filter(F.size("_k") > 0)
    return held.select(key, F.array_join(F.transform("_k", lambda x: x["t"]), ", ").alias("ids"), _mean(F.col("_k")).alias("conf"))


def combine_fragments(candidates: DataFrame, key: str, order: str, most: int = 15, top: int = 5) -> DataFrame:
    """Per image (text, conf) its best fragments joined, or the best alone where they are too long together or too weak."""
    held = _ranked(candidates, key, order)
    held = held.withColumn("_k", _apart(F.filter(F.slice("_all", 1, top), lambda x: x["s"] > 0.3), top))
    joined, best = F.array_join(F.transform("_k", lambda x: x["t"]), ""), F.get("_all", F.lit(0))
    fits = (F.size("_k") > 0) & (F.char_length(joined) <= most)
    return held.select(key, F.when(fits, joined).otherwise(best["t"]).alias("text"), F.when(fits, _mean(F.col("_k"))).otherwise(best["c"]).alias("conf"))


def reading_summary(readings: DataFrame) -> DataFrame:
    return readings.groupBy("method").agg(F.count("*").alias("processed"), F.count_if(F.col("method") == "error").alias("failed"), F.count_if(nz("text").isNotNull()).alias("successful"))


def engine_comparison(readings: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Per image how many engines match the expected text (one holds the other, in any case) and the surest of them."""
    both = readings.join(expected, key)
    a, b = F.upper(F.coalesce(nz("text"), F.lit(""))), F.upper(nz("expected"))
    hit = (a != "") & (a.contains(b) | b.contains(a))
    rows = both.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    best = F.min_by(F.when(F.col("_hit"), F.col("engine")), F.when(F.col("_hit"), F.struct(-F.col("conf"), F.col("engine"))))
    return rows.groupBy(key).agg(F.count_if("_hit").alias("matches"), F.when(F.count_if("_hit") > 0, "match").otherwise("no_match").alias("status"), best.alias("best_engine"))


def latency_summary(df: DataFrame, by: str, ms: str = "ms") -> DataFrame:
    return df.groupBy(by).agg(F.avg(ms).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), (1000 / F.avg(ms)).alias("per_second"))
