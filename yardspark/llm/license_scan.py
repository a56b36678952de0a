"""Licence recognition from sentences, with DataFrame functions only.

A text is cut into sentences at sentence ends, and a sentence at its line breaks unless lines together are a known
sentence; each sentence is normalised and mapped to the identifier of the known licence sentence it
matches, and the sequence of identifiers is matched against ordered rules: a rule whose identifiers stand next to each
other is replaced by its licence, the longest and most specific rules first, and what is left is reported as unmatched.

A null or empty text has no sentences. Every known sentence holds one of CUES, so other texts need no cutting. Rows
are judged alone, also where their ids repeat or are null. The first pattern that matches a sentence names it, so ties
cannot occur. An empty table gives an empty one; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings of which every known licence sentence holds at least one.
CUES = r"licen[sc]e|licensed|copyright|warrant|permission|redistribut|public[^a-z0-9.]+domain|spdx|rights[^a-z0-9.]+reserved|\bcc0\b"

#: Identifiers of licence sentences and the patterns of their normalised forms, in order of trial.
SENTENCES = [
    ("spdx", r"^spdx license identifier [a-z0-9.+ -]+$"),
    ("apacheVer2", r"licensed under (the )?apache license,? version 2(\.0)?"),
    ("apacheMayNotUse", r"you may not use this file except in compliance with the license"),
    ("apacheObtain", r"you may obtain a copy of the license at"),
    ("asIsBasis", r"distributed under the license is distributed on an as is basis"),
    ("seeLicense", r"see the license for the specific language governing permissions and limitations"),
    ("mitName", r"(released|licensed|distributed) under (the )?(terms of the )?mit license"),
    ("mitGrant", r"^permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mitNotice", r"the above copyright notice and this permission notice shall be included"),
    ("asIsMit", r"the software is provided as is,? without warranty of any kind"),
    ("bsdGrant", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("bsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsdEndorse", r"may be used to endorse or promote products .* without specific prior written permission"),
    ("bsdName", r"(released|licensed|distributed) under (the )?(new |simplified |[23] clause )?bsd license"),
    ("agpl3", r"licensed under (the )?(terms of the )?gnu affero general public license,? version 3"),
    ("lgpl21", r"licensed under (the )?(terms of the )?gnu (lesser|library) general public license,? version 2\.1"),
    ("lgpl3", r"licensed under (the )?(terms of the )?gnu (lesser|library) general public license,? version 3"),
    ("gpl2", r"licensed under (the )?(terms of the )?gnu general public license,? version 2"),
    ("gpl3", r"licensed under (the )?(terms of the )?gnu general public license,? version 3"),
    ("lgpl21Redistribute", r"modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation either version 2\.1 of the license"),
    ("lgpl3Redistribute", r"modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation either version 3 of the license"),
    ("agpl3Redistribute", r"modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("gpl2Redistribute", r"modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl3Redistribute", r"modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("eitherVersion2", r"^either version 2 of the license"),
    ("eitherVersion21", r"^either version 2\.1 of the license"),
    ("eitherVersion3", r"^either version 3 of the license"),
    ("gplHope", r"distributed in the hope that it will be useful but without any warranty"),
    ("gplReceived", r"you should have received a copy of the gnu (lesser |library |affero )?general public license along with this"),
    ("gplSee", r"^if not see (https? )?(www\.)?gnu\.org licenses"),
    ("gplRedistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gplWarranty", r"without even the implied warranty of merchantability or fitness"),
    ("iscGrant", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("asIsIsc", r"the software is provided as is and the author disclaims all warranties"),
    ("zlibAsIs", r"this software is provided as is without any express or implied warranty"),
    ("zlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("boostGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("asIsBsd", r"this software is provided by (the )?(copyright holders?|regents|author)( and contributors)? as is"),
    ("lgplRedistribute", r"you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agplRedistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gfdlGrant", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("oflGrant", r"this font software is licensed under the sil open font license"),
    ("ccByNcNd", r"licensed under (a )?(cc by nc nd|creative commons attribution noncommercial noderivatives)"),
    ("ccByNcSa", r"licensed under (a )?(cc by nc sa|creative commons attribution noncommercial sharealike)"),
    ("ccByNc", r"licensed under (a )?(cc by nc|creative commons attribution noncommercial)"),
    ("ccBySa", r"licensed under (a )?(cc by sa|creative commons attribution sharealike)"),
    ("ccBy", r"licensed under (a )?(cc by|creative commons attribution)"),
    ("cc0", r"(released|licensed|distributed|published|available|provided|covered|dedicated|waived) (under|by|to|via|with) (the )?(terms of )?(the )?(creative commons )?cc0\b|^(licen[sc]e |the )?(creative commons )?cc0( 1\.0)?( universal)?( licen[sc]e| public domain dedication)?$|dedicated to the public domain|released into the public domain"),
    ("mozilla2", r"subject to the terms of the mozilla public license,? (version |v )?2\.0"),
    ("allRights", r"^(copyright .*)?all rights reserved$"),
    ("copyright", r"^copyright (c )?[0-9]{4}"),
]
#: Licences that texts name, by SPDX identifier, as their normalised names.
NAMES = {
    "0BSD": r"(zero clause bsd|bsd zero clause|0bsd) license", "AFL-3.0": r"academic free license( version| v)? ?3\.0", "Apache-1.1": r"apache (software )?license( version| v)? ?1\.1", "APSL-2.0": r"apple public source license( version| v)? ?2\.0",
    "Artistic-1.0": r"artistic license( version| v)? ?1\.0", "Artistic-2.0": r"artistic license( version| v)? ?2\.0", "BlueOak-1.0.0": r"blue oak model license", "BSL-1.0": r"boost software license", "BUSL-1.1": r"business source license", "CDDL-1.0": r"common development and distribution license( version| v)? ?1\.0",
    "CECILL-2.1": r"cecill( free software)? license( version| v)? ?2\.1", "CPAL-1.0": r"common public attribution license", "CPL-1.0": r"common public license", "curl": r"curl license", "ECL-2.0": r"educational community license", "EFL-2.0": r"eiffel forum license",
    "Elastic-2.0": r"elastic license( version| v)? ?2\.0", "EPL-1.0": r"eclipse public license( version| v)? ?1\.0", "EPL-2.0": r"eclipse public license( version| v)? ?2\.0", "EUPL-1.1": r"european union public licen[cs]e( version| v)? ?1\.1", "EUPL-1.2": r"european union public licen[cs]e( version| v)? ?1\.2",
    "GFDL-1.3": r"gnu free documentation license( version| v)? ?1\.3", "HPND": r"historical permission notice and disclaimer license", "IPL-1.0": r"ibm public license", "ISC": r"isc license", "LPPL-1.3c": r"latex project public license", "MIT-0": r"mit no attribution license",
    "MPL-1.1": r"mozilla public license( version| v)? ?1\.1", "MPL-2.0": r"mozilla public license( version| v\.?)? ?2\.0", "MS-PL": r"microsoft public license", "MS-RL": r"microsoft reciprocal license", "MulanPSL-2.0": r"mulan permissive software license", "NCSA": r"(university of illinois )?ncsa open source license",
    "NPL-1.1": r"netscape public license", "ODbL-1.0": r"(odc )?open database license", "ODC-By-1.0": r"open data commons attribution license", "OFL-1.1": r"(sil )?open font license", "OpenSSL": r"openssl license", "OSL-3.0": r"open software license( version| v)? ?3\.0", "PHP-3.01": r"php license",
    "PostgreSQL": r"postgresql license", "Python-2.0": r"python( software foundation)? license", "QPL-1.0": r"q public license", "Ruby": r"ruby license", "Sleepycat": r"sleepycat license", "SSPL-1.0": r"server side public license", "Unlicense": r"unlicense( license)?", "UPL-1.0": r"universal permissive license",
    "Vim": r"vim license", "W3C": r"w3c software( notice and)? license", "WTFPL": r"(do what the fuck you want to public license|wtfpl license)", "X11": r"x11 license", "Zlib": r"zlib license", "ZPL-2.1": r"zope public license",
}
#: The sentences that name a licence: under its terms, or its name alone as a heading.
SENTENCES += [(f"is{spdx}", rf"(released|licensed|distributed|published|available|provided|covered|governed|subject) (under|by|to) (the )?(terms (and conditions )?of )?(the )?{name}|^(the )?{name}( version [0-9.]+)?$") for spdx, name in NAMES.items()]
#: Identifiers of sentences that say under which licence something is, rather than being part of one.
NAMING = ["apacheVer2", "mitName", "bsdName", "agpl3", "lgpl21", "lgpl3", "gpl2", "gpl3", "ccByNcNd", "ccByNcSa", "ccByNc", "ccBySa", "ccBy", "cc0", "mozilla2", *[f"is{spdx}" for spdx in NAMES]]
_UNDER = "(released|licensed|distributed|published|available|provided|covered|governed|dedicated)"
#: Sentences that name a licence to say that it does not hold, or that it holds for something else.
DENIED = rf"\b(not|never|neither|nor|longer|cannot|isn t|aren t|wasn t|weren t)( [a-z0-9.]+)? {_UNDER}\b|\b(whereas|unlike|in contrast to|as opposed to)\b|\b(most|many|some|several|few|other)( [a-z0-9.]+)? [a-z0-9.]+ (is|are|was|were|has been|have been) {_UNDER}\b"
#: Rules as a licence and the identifiers that stand next to each other, tried in this order.
_GNU = [
    (licence, [*head, *tail])
    for tail in (["gplHope", "gplWarranty", "gplReceived", "gplSee"], ["gplHope", "gplWarranty", "gplReceived"], ["gplHope", "gplWarranty"], ["gplWarranty"], [])
    for licence, head in (
        ("LGPL-2.1", ["lgpl21Redistribute"]), ("LGPL-2.1", ["lgplRedistribute", "eitherVersion21"]), ("LGPL-3.0", ["lgpl3Redistribute"]), ("LGPL-3.0", ["lgplRedistribute", "eitherVersion3"]),
        ("AGPL-3.0", ["agpl3Redistribute"]), ("AGPL-3.0", ["agplRedistribute", "eitherVersion3"]),
        ("GPL-2.0", ["gpl2Redistribute"]), ("GPL-2.0", ["gplRedistribute", "eitherVersion2"]), ("GPL-3.0", ["gpl3Redistribute"]), ("GPL-3.0", ["gplRedistribute", "eitherVersion3"]),
    )
]
RULES = [
    ("Apache-2.0", ["apacheVer2", "apacheMayNotUse", "apacheObtain", "asIsBasis", "seeLicense"]),
    ("Apache-2.0", ["apacheVer2", "apacheMayNotUse"]),
    ("MIT", ["mitGrant", "mitNotice", "asIsMit"]),
    ("MIT", ["mitName", "mitGrant"]),
    ("BSD-3-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdEndorse"]),
    ("BSD-2-Clause", ["bsdGrant", "bsdSource", "bsdBinary"]),
    ("ISC", ["iscGrant", "asIsIsc"]),
    ("Zlib", ["zlibAsIs", "zlibGrant"]),
    *_GNU,
    ("LGPL", ["lgplRedistribute", "gplWarranty"]),
    ("AGPL", ["agplRedistribute", "gplWarranty"]),
    ("GPL-3.0", ["gpl3", "gplWarranty"]),
    ("GPL-2.0", ["gpl2", "gplWarranty"]),
    ("GPL", ["gplRedistribute", "gplWarranty"]),
    ("Apache-2.0", ["apacheVer2"]),
    ("MIT", ["mitName"]),
    ("BSD", ["bsdName"]),
    ("AGPL-3.0", ["agpl3"]),
    ("LGPL-2.1", ["lgpl21"]),
    ("LGPL-3.0", ["lgpl3"]),
    ("GPL-2.0", ["gpl2"]),
    ("GPL-3.0", ["gpl3"]),
    ("GPL", ["gplRedistribute"]),
    ("CC-BY-NC-ND", ["ccByNcNd"]),
    ("CC-BY-NC-SA", ["ccByNcSa"]),
    ("CC-BY-NC", ["ccByNc"]),
    ("CC-BY-SA", ["ccBySa"]),
    ("CC-BY", ["ccBy"]),
    ("CC0", ["cc0"]),
    ("MPL-2.0", ["mozilla2"]),
    ("ISC", ["iscGrant"]),
    ("Zlib", ["zlibGrant"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boostGrant"]),
    ("LGPL", ["lgplRedistribute"]),
    ("AGPL", ["agplRedistribute"]),
    ("GFDL", ["gfdlGrant"]),
    ("OFL-1.1", ["oflGrant"]),
    ("Proprietary", ["allRights"]),
]
#: A sentence that names a licence is enough for it.
RULES += [(spdx, [f"is{spdx}"]) for spdx in NAMES]


#: Normalised characters of unfinished lines that are kept while lines are joined; every known sentence is shorter.
HELD = 1000


def plain(s: Column) -> Column:
    """Lower case, other signs than letters, digits and full stops as single blanks."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9.]+", " "))


def sentences(text: Column) -> Column:
    """Sentences that hold a cue, each as the array of its lines; an SPDX tag is a sentence of its own."""
    tagged = F.regexp_replace(text, r"(?i)(spdx-license-identifier):[ \t]*([^\r\n]*)", "\u0001$1 $2\u0001")
    cut = F.split(F.regexp_replace(tagged, r"[.!?;:]+([ \t\r\n]|$)", "\u0001"), "\u0001", -1)
    return F.transform(F.filter(cut, lambda s: F.lower(s).rlike(CUES)), lambda s: F.split(s, "\n", -1))


def _let(value: Column, f) -> Column:
    """f(value) within a lambda, with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def line_id(line: Column, known=None) -> Column:
    """The identifier of a line by itself, with what an SPDX tag names behind `spdx=`; without a known sentence null."""
    named = F.regexp_extract(line, r"(?i)spdx-license-identifier:?[ \t]*(.*?)[^a-z0-9.+)]*$", 1)
    return _let(sentence_id(plain(line), known), lambda x: F.when(x == "spdx", F.concat(F.lit("spdx="), F.regexp_replace(named, "[|,]", " "))).otherwise(x))


def join_lines(lines: Column, known=None) -> Column:
    """Identifiers of a sentence's lines, where lines that only together are a known sentence get its identifier.

    A line that is known by itself begins anew. Others continue the lines before them: as long as these stay known (or
    become so) they are one, and no line of theirs counts as unknown. An empty line ends what stands before it.
    """
    none = F.lit(None).cast("string")
    state = lambda out, text, tail, name, cues: F.struct(out.alias("out"), text.alias("text"), tail.alias("tail"), name.alias("id"), cues.alias("cues"))
    begin = state(F.array().cast("array<string>"), F.lit(""), F.lit(""), none, F.lit(0))
    emit = lambda s: F.concat(s["out"], F.when(s["id"].isNotNull(), F.array(s["id"])).otherwise(F.array_repeat(F.lit("unknown"), s["cues"])))
    add = lambda a, b: F.trim(F.right(F.concat_ws(" ", a, b), F.lit(HELD)))

    def step(s: Column, x: Column) -> Column:
        def joined(j: Column) -> Column:
            grown, cues = add(s["text"], x["text"]), F.when(j["id"].isNull(), s["cues"] + x["cue"]).otherwise(0)
            on = state(s["out"], grown, F.when(j["id"] == s["id"], add(s["tail"], x["text"])).otherwise(F.lit("")), j["id"], cues)
            new = state(emit(s), add(s["tail"], x["text"]), F.lit(""), j["tail"], F.lit(0))
            alone = state(emit(s), x["text"], F.lit(""), none, x["cue"])
            return F.when(s["id"].isNotNull() & j["tail"].isNotNull(), new).when(s["id"].isNotNull() & j["id"].isNull(), alone).otherwise(on)

        both = F.struct(sentence_id(add(s["text"], x["text"]), known).alias("id"), sentence_id(add(s["tail"], x["text"]), known).alias("tail"))
        own = state(emit(s), x["text"], F.lit(""), x["id"], x["cue"])
        return F.when((x["text"] == "") | x["id"].isNotNull() | (s["text"] == ""), own).otherwise(_let(both, joined))

    parts = F.transform(lines, lambda x: F.struct(plain(x).alias("text"), line_id(x, known).alias("id"), F.lower(x).rlike(CUES).cast("int").alias("cue")))
    return F.aggregate(parts, begin, step, emit)


def sentence_ids(text: Column, known=None) -> Column:
    """Identifiers of all sentences in text order. Lines are joined only where the whole sentence holds a known one."""
    anywhere = "|".join(p.removeprefix("^").removesuffix("$") for _, p in known or SENTENCES)
    apart = lambda s: F.transform(F.filter(s, lambda x: F.lower(x).rlike(CUES)), lambda x: F.coalesce(line_id(x, known), F.lit("unknown")))
    wrapped = lambda s: (F.size(s) > 1) & plain(F.array_join(s, " ")).rlike(anywhere)
    return F.flatten(F.transform(sentences(text), lambda s: F.when(wrapped(s), join_lines(s, known)).otherwise(apart(s))))


def sentence_id(sentence: Column, known=None) -> Column:
    """The first known sentence that a normalised one is; one that names a licence counts unless it denies it."""
    out, said = None, ~sentence.rlike(DENIED)
    for name, pattern in known or SENTENCES:
        fits = sentence.rlike(pattern) & said if name in NAMING else sentence.rlike(pattern)
        out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
    return out


def apply_rules(sequence: Column, rules=None) -> Column:
    """`|a|b|` with every rule's run of identifiers replaced by `#licence`, rule after rule."""
    for licence, run in rules or RULES:
        sequence = F.replace(sequence, F.lit("".join(f"|{x}|" for x in run)), F.lit(f"|#{licence}|"))
    return sequence


def spdx_licences(name: Column, rules=None) -> Column:
    """`#a||#b` of an SPDX tag: the licences of its expression, each with its exception, written as the rules write them
    where they know them; other identifiers as they are."""
    bare = F.regexp_replace(F.substr(name, F.lit(6)), r"[()]", " ")
    tags = F.filter(F.transform(F.split(bare, r"(?i)\s+(?:and|or)\s+"), lambda x: F.trim(x)), lambda x: x != "")

    def written(tag: Column) -> Column:
        out = F.concat(F.lit("#"), tag)
        for licence in dict.fromkeys(x for x, _ in rules or RULES):
            out = F.when(F.lower(tag) == licence.lower(), F.lit(f"#{licence}")).otherwise(out)
        return out

    return F.when(name.startswith("spdx="), F.array_join(F.transform(tags, written), "||")).otherwise(name)


def scan_licences(docs: DataFrame, text: str = "text", known=None, rules=None) -> DataFrame:
    """docs with sentence_ids (in text order), licences (in text order, comma-separated) and n_unmatched.

    n_unmatched counts known sentences outside rules; sentences with a cue that no pattern knows have the id `unknown`
    and are not counted there but in n_unknown.
    """
    docs = docs.drop("sentence_ids", "licences", "n_unmatched", "n_unknown", "_ids", "_seq")
    ids = sentence_ids(F.col(text), known)
    found = docs.withColumn("_ids", F.when(F.lower(text).rlike(CUES), ids).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("_seq", apply_rules(F.concat_ws("", F.transform("_ids", lambda x: F.concat(F.lit("|"), spdx_licences(x, rules), F.lit("|")))), rules))
    parts = F.filter(F.split("_seq", r"\|"), lambda x: x != "")
    licences = F.array_join(F.transform(F.filter(parts, lambda x: x.startswith("#")), lambda x: F.substr(x, F.lit(2))), ",")
    return found.withColumns({
        "sentence_ids": F.array_join(F.transform("_ids", lambda x: F.regexp_replace(x, "^spdx=.*", "spdx")), ","),
        "licences": licences,
        "n_unmatched": F.size(F.filter(parts, lambda x: ~x.startswith("#") & (x != "unknown"))).cast("long"),
        "n_unknown": F.size(F.filter(F.col("_ids"), lambda x: x == "unknown")).cast("long"),
    }).drop("_ids", "_seq")
