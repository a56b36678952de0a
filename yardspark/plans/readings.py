"""Reading and dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardspark.operators import dataset as S
from yardspark.operators import readings as R
from yardspark.plans.views import sql, view

_AL = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _al(x):
    return _AL.format(x)


def _readings(s, d):
    return view(s, d, "readings")


def _noisy(s, d):
    """Texts of every shape the rules know, made from the readings themselves."""
    k = F.col("event_id") % 12
    t = F.col("text")
    shaped = (
        F.when(k == 0, "NONE").when(k == 1, F.concat(F.lit(" "), t, F.lit("  #!"))).when(k == 2, F.repeat(F.substring(F.concat(t, F.lit("J")), 1, 1), 70)).when(k == 3, "JBHU 342345")
        .when(k == 4, F.concat_ws(" ", (F.col("track") % 90 + 10).cast("string"), (F.col("track") % 10).cast("string"))).when(k == 5, F.concat_ws(" ", t, t, F.lit("WB 7"), t, F.lit("WB 7")))
        .when(k == 6, F.concat(F.lit("xAPPSx"), t)).when(k == 7, F.concat_ws("-", F.lit("HUB"), (F.col("track") % 7).cast("string"))).when(k == 8, F.lit("IL")).otherwise(t)
    )
    return _readings(s, d).withColumn("text", shaped)


_NOISY = """nz as (select event_id, track, conf, case event_id % 12 when 0 then 'NONE' when 1 then ' ' || text || '  #!' when 2 then repeat(substr(text || 'J', 1, 1), 70) when 3 then 'JBHU 342345'
  when 4 then concat_ws(' ', track % 90 + 10, track % 10) when 5 then concat_ws(' ', text, text, 'WB 7', text, 'WB 7') when 6 then 'xAPPSx' || text when 7 then concat_ws('-', 'HUB', track % 7) when 8 then 'IL' else text end as text from readings)"""
_TRIM = "nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')"
_HAS_L, _HAS_D = "regexp_matches({}, '\\p{{L}}')", "regexp_matches({}, '[0-9]')"
_ALL_D = "regexp_matches({}, '^[0-9]+$')"


def _l(x):
    return _HAS_L.format(x)


def _d(x):
    return _HAS_D.format(x)


def _n(x):
    return _ALL_D.format(x)


_GARBAGE = "(" + " or ".join(f"contains(upper({{0}}), '{g}')" for g in R.GARBAGE_IN) + " or upper({0}) in (" + ", ".join(f"'{g}'" for g in R.GARBAGE_IS) + "))"
_ANY = "(" + " or ".join(f"contains(upper({{0}}), '{g}')" for g in R.GARBAGE_IN + R.GARBAGE_IS + R.MISREAD + R.FRAGMENTS) + ")"
_IDS = "(" + " or ".join(f"contains(upper({{0}}), '{g}')" for g in R.GARBAGE_IN + R.GARBAGE_IS + R.MISREAD) + ")"
_NOISE = f"""with {_NOISY}, c as (select event_id, coalesce({_TRIM}, '') as t from nz), b as (select *, {_al('t')} as body from c),
k as (select *, string_split(body, '') as ch, length(t) as n from b), m as (select *, list_distinct(list_filter(ch, lambda x: x <> '')) as kinds from k),
f as (select *, case when len(kinds) = 0 then null else list_max(list_transform(kinds, lambda c: len(list_filter(ch, lambda x: x = c)))) end as most, len(kinds) as few from m)
select event_id, case when n < 1 then 'empty' when upper(t) = 'NONE' then 'none' when replace(upper(t), ' ', '') = 'JBHU342345' then 'hallucination'
  when n >= 60 and length(body) > 30 and most / length(body) > 0.75 then 'repeated' when (n > 120 and few < 3) or (n > 80 and n <= 120 and few < 5) then 'few_signs' end as reject_reason from f"""
_CLEAN = f"""with {_NOISY}, c as (select event_id, trim(regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}} _-]', '', 'g'), ' +', ' ', 'g')) as k from nz)
select event_id, case when contains(k, ' ') then k else coalesce(nullif({_al('k')}, ''), k) end as text from c"""
_FULL = f"""with {_NOISY}, w as (select event_id, list_filter(string_split_regex(text, '\\s+'), lambda x: {_al('x')} <> '') as w from nz),
o as (select event_id, list_filter(w, lambda x, i: len(list_filter(w[:i - 1], lambda y: upper({_al('y')}) = upper({_al('x')}))) = 0) as w from w)
select event_id, coalesce(array_to_string(list_filter(w, lambda x: length({_al('x')}) > 2 or {_d(_al('x'))}), ' '), '') as text from o"""
_REORDER = f"""with {_NOISY}, p as (select event_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as f from nz),
u as (select *, array_to_string(f, '') as j, len(f) between 2 and 3 and len(list_filter(f, lambda x: not {_n('x')})) = 0 and length(array_to_string(f, '')) between 2 and 15 as ok from p),
c as (select event_id, text, ok, j, f, list_filter(f, lambda x: length(x) = 1)[1] as one, array_to_string(list_filter(f, lambda x: length(x) > 1), '') as many from u),
a as (select event_id, text, unnest(case when one is not null and many <> '' then [one || many, many || one, j] else [j] end) as cand, unnest(case when one is not null and many <> '' then [0, 1, 2] else [0] end) as i, one from c where ok),
b as (select event_id, cand, row_number() over (partition by event_id order by -(case when length(cand) between 3 and 6 then 10 when length(cand) = 2 then 5 when length(cand) between 7 and 8 then 8 else 3 end + case when one is not null and starts_with(cand, one) then 2 else 0 end), i) as rn from a where length(cand) between 2 and 15)
select nz.event_id, coalesce(cand, text) as text from nz left join (select * from b where rn = 1) q using (event_id)"""
_PCONF = f"case when {_l('text')} and {_d('text')} then 0.85 when {_n('text')} then 0.80 when {_l('text')} then 0.70 else 0.50 end"
_SCORE = f"""with {_NOISY}, s as (select event_id, conf, {_al('text')} as t, cast(track % 60 as double) / 100 as ra, cast(track % 10 as double) / 10 as cd from nz),
b as (select *, not (length(t) between 2 and 15) or {_ANY.format('t')} or (length(t) = 2 and not ({_n('t')} and conf > 0.8)) or (length(t) <= 3 and regexp_matches(t, '^\\p{{L}}+$') and conf < 0.9) as bad from s)
select event_id, round(case when not bad then conf * case when ra between 0.01 and 0.5 then 1.2 when ra < 0.01 then 0.7 else 0.5 end * case when length(t) between 3 and 12 then 1.3 when length(t) = 2 or length(t) between 13 and 15 then 1.1 else 1.0 end
  * case when {_l('t')} and {_d('t')} then 1.2 when {_d('t')} then 1.1 else 1.0 end * case when cd < 0.3 then 1.1 else 1.0 end end, 6) as score from b"""
_QUALITY = f"(least(length({{0}}), 20) * 0.1::double + case when {_l('{0}')} and {_d('{0}')} then 5.0 when {_l('{0}')} then 2.0 when {_d('{0}')} then 1.0 else 0.0 end - length(regexp_replace({{0}}, '[\\p{{L}}\\p{{N}} .-]', '', 'g')) * 0.5::double)".replace("{{L}}", "{L}").replace("{{N}}", "{N}")


def _q(x):
    return _QUALITY.replace("{0}", x)


_VALID = f"(length(t) >= 2 and (({_l('t')} and ({_d('t')} or length(t) >= 4)) or ({_d('t')} and length(t) >= 4 and not {_l('t')})))"
_COMPANY = "case " + " ".join(f"when contains(upper(t), '{p}') then '{p}'" for p in R.COMPANIES) + " end"
_CONSOLIDATE = f"""with base as (select *, {_TRIM} as t from readings), totals as (select track, count(*) as total, min(event_id) as first_seen from base group by 1),
votes as (select track, t, count(*) as n, avg(conf) as c, min(event_id) as o from base where t is not null group by 1, 2),
sc as (select *, n * (1 + c) + case when {_VALID} then {_q('t')} * 2 else -2.0 end as s, {_COMPANY} as company, regexp_extract_all(t, '\\d+') as runs from votes),
best as (select * from (select *, row_number() over (partition by track order by s desc, o) as rn, count(*) over (partition by track) as texts from sc) where rn = 1),
comp as (select * from (select *, row_number() over (partition by track order by n * (1 + c) desc, o) as rn from sc where company is not null) where rn = 1),
nums as (select track, n, o, unnest(list_transform(list_filter(runs, lambda x: length(x) between 3 and 8), lambda x: {{'d': x, 'c': c * case when length(x) = 3 then 0.7 else 1.0 end}})) as r from sc),
num as (select * from (select track, r.d as d, n, r.c as c, row_number() over (partition by track order by n * (1 + r.c) * case when length(r.d) = 6 then 1.5 when length(r.d) in (5, 7) then 1.2 when length(r.d) in (4, 8) then 1.1 else 1.0 end desc, o) as rn from nums) where rn = 1),
j as (select b.track, b.t, b.c, b.s, b.texts, case when length(num.d) between 4 and 8 then k.company || ' ' || num.d end as joint, (k.c + num.c) / 2 as jc, k.n + num.n as jn from best b left join comp k using (track) left join num using (track)),
w as (select *, coalesce(jn * (1 + jc) + {_q('joint')} * 5 > s, false) as wins from j)
select track, coalesce(case when wins then joint else t end, '') as text, round(coalesce(case when wins then jc else c end, 0), 6) as conf, first_seen, total, coalesce(texts, 0) as texts from totals left join w using (track)"""


def _attempts(s, d):
    return _noisy(s, d).withColumn("method", F.when(F.col("event_id") % 5 == 0, "Rotated90").when(F.col("event_id") % 5 == 1, "plain").otherwise("clahe")).withColumn("image", F.floor(F.col("event_id") / 5))


_ATT = f"{_NOISY}, att as (select *, case event_id % 5 when 0 then 'Rotated90' when 1 then 'plain' else 'clahe' end as method, cast(floor(event_id / 5) as bigint) as image from nz)"
_BEST = f"""with {_ATT}, c as (select *, {_TRIM} as t from att), s as (select *, conf * case when {_l('t')} and {_d('t')} then 1.2 when {_d('t')} then 1.1 when {_l('t')} and length(t) >= 4 then 1.05 else 1.0 end
  * case when length(t) between 3 and 12 then 1.15 when length(t) between 4 and 15 then 1.08 else 1.0 end * case when contains(lower(method), 'rotated') then 1.15 else 1.0 end as score from c where t is not null and conf >= 0.01),
b as (select * from (select *, row_number() over (partition by image order by score desc, event_id) as rn from s) where rn = 1)
select image, coalesce(b.t, '') as text, coalesce(b.conf, 0) as conf, coalesce(b.method, 'none') as method from (select distinct image from att) left join b using (image)"""
_MERGE = f"""with {_ATT}, w as (select image, event_id, conf, unnest(string_split_regex(text, '\\s+')) as w, generate_subscripts(string_split_regex(text, '\\s+'), 1) as i from att),
k as (select *, upper({_al('w')}) as k from w), f as (select *, row_number() over (partition by image, k order by event_id, i) as rn from k where k <> '')
select image, string_agg(w, ' ' order by event_id, i) as text, round(avg(conf), 9) as conf from f where rn = 1 group by 1"""


def _preambles(s, d):
    """Answers with the prefixes and role lines that text models put around a reading."""
    k, t = F.col("event_id") % 8, F.coalesce("text", F.lit(""))
    texts = [F.concat(F.lit("Content: "), t), F.concat(F.lit("I can see: "), t), F.concat(F.lit("assistant\n\n"), t), F.concat(F.lit("THE IMAGE CONTAINS: a\nuser\n"), t), F.concat(F.lit("x The text is: "), t, F.lit("\n\n  b")), F.lit("Assistant"), F.concat(F.repeat(F.lit("long. "), 100), t)]
    shaped = t
    for i, c in enumerate(texts):
        shaped = F.when(k == i, c).otherwise(shaped)
    return _noisy(s, d).select("event_id", R.strip_preamble(shaped).alias("text"))


# by hand: what each shape leaves of the reading
_PREAMBLE = f"""with {_NOISY}, t as (select event_id, event_id % 8 as k, coalesce(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') as t from nz)
select event_id, case k when 3 then trim('a ' || t) when 4 then trim(t || ' b') when 5 then '' else t end as text from t"""


def _candidates(s, d):
    """Scored candidates of five readings each, with ids that hold each other, misread signs and short ones."""
    k, n = F.col("event_id") % 5, (F.col("track") % 900 + 100).cast("string")
    t = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("12"))).when(k == 2, F.when(F.col("track") % 2 == 0, "36CBX").otherwise(F.concat(F.lit("A9"), n))).when(k == 3, F.concat(F.lit("MARJON"), F.substring(n, 1, 1))).otherwise("12")
    rows = _readings(s, d).select("event_id", F.floor(F.col("event_id") / 5).alias("image"), t.alias("text"), "conf", "track")
    score = R.candidate_score(F.col("text"), F.col("conf"), (F.col("track") % 60).cast("double") / 100, (F.col("track") % 10).cast("double") / 10)
    return rows.withColumn("score", F.round(score, 6)).filter("score is not null")


_CANDIDATES = f"""r as (select event_id, cast(floor(event_id / 5) as bigint) as image, conf, track, cast(track % 900 + 100 as varchar) as n from readings),
t as (select *, case event_id % 5 when 0 then n when 1 then n || '12' when 2 then case when track % 2 = 0 then '36CBX' else 'A9' || n end when 3 then 'MARJON' || n[1] else '12' end as t, cast(track % 60 as double) / 100 as ra, cast(track % 10 as double) / 10 as cd from r),
b as (select *, not (length(t) between 2 and 15) or {_ANY.format('t')} or (length(t) = 2 and not (conf > 0.8)) as bad from t),
q as (select event_id, image, t, conf, round(conf * case when ra between 0.01 and 0.5 then 1.2 when ra < 0.01 then 0.7 else 0.5 end * case when length(t) between 3 and 12 then 1.3 else 1.1 end
  * case when {_l('t')} then 1.2 else 1.1 end * case when cd < 0.3 then 1.1 else 1.0 end, 6) as score from b where not bad)"""
_FOLD = "list_reduce(list_transform({0}, lambda x: [x]), lambda acc, x: case when len(acc) >= {1} or len(list_filter(acc, lambda y: contains(y.t, x[1].t) or contains(x[1].t, y.t))) > 0 then acc else list_concat(acc, x) end)"
_DISTINCT = f"""with {_CANDIDATES}, l as (select image, list({{'t': t, 'c': conf}} order by score desc, event_id) as l from q
  where (({_n('t')} and length(t) between 3 and 8) or ({_l('t')} and {_d('t')} and length(t) between 4 and 12)) and not {_IDS.format('t')} and score > 0.5 and conf > 0.6 group by 1),
k as (select image, {_FOLD.format('l', 10)} as k from l)
select image, array_to_string(list_transform(k, lambda x: x.t), ', ') as ids, round(list_avg(list_transform(k, lambda x: x.c)), 6) as conf from k"""
_COMBINE = f"""with {_CANDIDATES}, l as (select image, list({{'t': t, 'c': conf, 's': score}} order by score desc, event_id) as l from q group by 1),
f as (select image, l[1] as best, list_filter(l[:5], lambda x: x.s > 0.3) as l from l),
k as (select image, best, case when len(l) = 0 then l else {_FOLD.format('l', 5)} end as k from f),
j as (select *, len(k) > 0 and length(array_to_string(list_transform(k, lambda x: x.t), '')) <= 15 as fits from k)
select image, case when fits then array_to_string(list_transform(k, lambda x: x.t), '') else best.t end as text, round(case when fits then list_avg(list_transform(k, lambda x: x.c)) else best.c end, 6) as conf from j"""


def _crops(s, d):
    return view(s, d, "scans").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("crop_filename"), F.col("spot_name").alias("spot"), "k")


def _texts(s, d):
    return _readings(s, d).filter("event_id % 3 > 0").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("crop_filename"), "text", "conf", F.lit("engine").alias("method"))


def _engines(s, d):
    return _readings(s, d).select(F.floor(F.col("event_id") / 4).alias("image"), (F.col("event_id") % 4).cast("string").alias("engine"), "text", "conf")


def _truth(s, d):
    return _readings(s, d).filter("event_id % 4 = 0").select(F.floor(F.col("event_id") / 4).alias("image"), F.substring("text", 3, 6).alias("expected"))


_PHRASES = sql(f"""with recursive {_NOISY}, p as (select event_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from nz),
o as (select event_id, list_filter(w, lambda x, i: i = 1 or x <> w[i - 1]) as w from p),
f as (select event_id, w, 1 as i, []::varchar[] as kept, []::varchar[] as seen from o
  union all select event_id, w, case when again then i + 2 else i + 1 end, case when again then kept else list_append(kept, w[i]) end, case when again or len(kept) = 0 then seen else list_append(seen, kept[-1] || ' ' || w[i]) end
  from (select *, len(kept) > 0 and i < len(w) and list_contains(seen, w[i] || ' ' || w[i + 1]) as again from f where i <= len(w)))
select event_id, array_to_string(kept, ' ') as text from f where i > len(w)""", "readings")


def _labels(s, d):
    return s.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("cls"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 50).cast("string")).alias("file"))


def _split(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    labels = s.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit(True).alias("has_label"))
    out = S.split_dataset(docs, "doc_id", 0.2, 7).join(labels, "doc_id", "left").withColumn("has_label", F.coalesce("has_label", F.lit(False)))
    return out


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


QUERIES = {
    "reject_noise": (lambda s, d: R.reject_noise(_noisy(s, d)).select("event_id", "reject_reason"), sql(_NOISE, "readings")),
    "clean_single": (lambda s, d: _noisy(s, d).select("event_id", R.clean_single(F.col("text")).alias("text")), sql(_CLEAN, "readings")),
    "clean_full": (lambda s, d: _noisy(s, d).select("event_id", R.clean_full(F.col("text")).alias("text")), sql(_FULL, "readings")),
    "reorder_digits": (lambda s, d: _noisy(s, d).select("event_id", R.reorder_digits(F.col("text")).alias("text")), sql(_REORDER, "readings")),
    "pattern_confidence": (lambda s, d: _noisy(s, d).select("event_id", R.pattern_confidence(F.col("text")).alias("conf")), sql(f"with {_NOISY} select event_id, {_PCONF}::double as conf from nz", "readings")),
    "reject_garbage": (lambda s, d: _noisy(s, d).select("event_id", R.is_garbage(F.col("text")).alias("garbage")), sql(f"with {_NOISY} select event_id, {_GARBAGE.format('text')} as garbage from nz", "readings")),
    "dedupe_phrases": (lambda s, d: _noisy(s, d).select("event_id", R.dedupe_phrases(F.col("text")).alias("text")), _PHRASES),
    "valid_id": (lambda s, d: _noisy(s, d).select("event_id", R.valid_id(F.col("text"), F.col("conf")).alias("valid")), sql(f"with {_NOISY} select event_id, length(text) between 2 and 15 and ({_n('text')} or ({_l('text')} and {_d('text')}) or ({_l('text')} and not {_d('text')} and conf >= 0.7)) as valid from nz", "readings")),
    "reject_short": (lambda s, d: _noisy(s, d).select("event_id", R.reject_short(F.substring("text", 1, 2), F.col("conf")).alias("text")), sql(f"with {_NOISY}, c as (select event_id, conf, coalesce(nullif(regexp_replace(substr(text, 1, 2), '^\\s+|\\s+$', '', 'g'), ''), '') as s from nz) select event_id, case when conf >= 0.15 and (length(s) >= 2 or (regexp_matches(s, '^[0-9]$') and conf >= 0.25)) then s else '' end as text from c", "readings")),
    "score_candidates": (lambda s, d: _noisy(s, d).select("event_id", F.round(R.candidate_score(F.col("text"), F.col("conf"), (F.col("track") % 60).cast("double") / 100, (F.col("track") % 10).cast("double") / 10), 6).alias("score")), sql(_SCORE, "readings")),
    "strip_preamble": (_preambles, sql(_PREAMBLE, "readings")),
    "match_readings": (lambda s, d: R.match_readings(_crops(s, d), _texts(s, d)), sql("select 'c' || id as crop_filename, coalesce(spot_name, 'unknown') as spot, k, case when id % 3 > 0 then r.text else '' end as ocr_text, case when id % 3 > 0 then r.conf else 0 end as ocr_conf, case when id % 3 > 0 then 'engine' else 'not_found' end as ocr_method from scans join readings r on r.event_id = id", "scans", "readings")),
    "consolidate_readings": (lambda s, d: _rounded(R.consolidate_readings(_readings(s, d)), 6, "conf"), sql(_CONSOLIDATE, "readings")),
    "best_reading": (lambda s, d: R.best_reading(_attempts(s, d), "image", "event_id"), sql(_BEST, "readings")),
    "merge_readings": (lambda s, d: _rounded(R.merge_readings(_attempts(s, d), "image", "event_id"), 9, "conf"), sql(_MERGE, "readings")),
    "distinct_ids": (lambda s, d: _rounded(R.distinct_ids(_candidates(s, d), "image", "event_id"), 6, "conf"), sql(f"with {_DISTINCT[5:]}", "readings")),
    "combine_fragments": (lambda s, d: _rounded(R.combine_fragments(_candidates(s, d), "image", "event_id"), 6, "conf"), sql(f"with {_COMBINE[5:]}", "readings")),
    "reading_summary": (lambda s, d: R.reading_summary(_attempts(s, d)), sql(f"with {_ATT} select method, count(*) as processed, 0 as failed, count(*) filter ({_TRIM} is not null) as successful from att group by 1", "readings")),
    "engine_comparison": (lambda s, d: R.engine_comparison(_engines(s, d), _truth(s, d), "image"), sql("with e as (select cast(floor(event_id / 4) as bigint) as image, cast(event_id % 4 as varchar) as engine, text, conf from readings), x as (select cast(floor(event_id / 4) as bigint) as image, substr(text, 3, 6) as expected from readings where event_id % 4 = 0), h as (select e.*, coalesce(nullif(trim(text), '') is not null and (contains(upper(trim(text)), upper(expected)) or contains(upper(expected), upper(trim(text)))), false) as hit from e join x using (image)) select image, count(*) filter (hit) as matches, case when count(*) filter (hit) > 0 then 'match' else 'no_match' end as status, arg_min(engine, {'c': -conf, 'e': engine}) filter (hit) as best_engine from h group by 1", "readings")),
    "latency_summary": (lambda s, d: _rounded(R.latency_summary(view(s, d, "scans"), "camera_id", "speed"), 6, "mean_ms", "min_ms", "max_ms", "per_second"), sql("select camera_id, round(avg(speed), 6) as mean_ms, round(min(speed), 6) as min_ms, round(max(speed), 6) as max_ms, round(1000 / avg(speed), 6) as per_second from scans group by 1", "scans")),
    "split_dataset": (lambda s, d: _split(s, d).select("doc_id", "split"), "select doc_id, case when row_number() over (order by md5(doc_id || '-7'), doc_id) <= floor(count(*) over () * 0.2) then 'val' else 'train' end as split from documents"),
    "split_summary": (lambda s, d: S.split_summary(_split(s, d).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train"))), "select case when doc_id % 5 = 0 then 'val' else 'train' end as split, count(*) as images, count(*) filter (doc_id in (select doc_id from labels)) as labels, round(count(*) filter (doc_id in (select doc_id from labels)) / count(*), 6) as ratio from documents group by 1"),
    "remap_classes": (lambda s, d: S.remap_classes(_labels(s, d), 1, 0).select("doc_id", "cls"), "select doc_id, 0 as cls from labels where quality = 1"),
    "relabel_summary": (lambda s, d: S.relabel_summary(_labels(s, d), 1), "select 'f' || cast(floor(doc_id / 50) as bigint) as file, count(*) filter (quality = 1) as converted, count(*) filter (quality <> 1) as removed from labels group by 1"),
    "missing_labels": (lambda s, d: S.missing_labels(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("stem")), s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("stem"))), "select doc_id as stem from documents where doc_id not in (select doc_id from labels)"),
    "continue_numbering": (lambda s, d: S.continue_numbering(view(s, d, "scans").filter("id < 4000").select(F.col("camera_id").alias("grp"), F.format_string("crop_%06d", F.col("k").cast("long")).alias("name")), view(s, d, "scans").filter("id >= 4000").select(F.col("camera_id").alias("grp"), "id"), "id"), sql("with t as (select camera_id, max(k) as top from scans where id < 4000 group by 1) select camera_id as grp, id, printf('crop_%06d', coalesce(top, 0) + row_number() over (partition by camera_id order by id)) as name from (select * from scans where id >= 4000) left join t using (camera_id)", "scans")),
    "attach_images": (lambda s, d: S.attach_images(view(s, d, "scans").select(F.floor(F.col("id") / 10).alias("batch"), (F.col("id") % 10).cast("int").alias("pos"), "id"), view(s, d, "scans").groupBy(F.floor(F.col("id") / 10).alias("batch")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("id", "camera_id"))), 1, 7), lambda x: x["camera_id"]).alias("images"))).select("id", "image"), sql("select id, case when id % 10 < 7 then camera_id end as image from scans", "scans")),
}
