"""Small tests of the training-data operators against brute force, with nulls, empties, ties and repeats."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from yardspark.llm import byte_bpe, decontaminate, jaccard_join, language_id, license_scan, line_dedup, mtree, packing, token_count, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "  a\n\n b  \t c　\x1cd   ", "日本語😀 don't I'LL 12345", "x" * 300, "aaaabababab " * 30, "ΑΣ ΣΑΣ İI é é", "<|endoftext|> a<|startoftext|>b", "word " * 4000]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with null and repeated ids and columns that clash with outputs."""
    rows = [(i, t, "score") for i, t in enumerate(ODD)] + [(None, "null id text", "x"), (3, "repeated id", "x"), (3, "repeated id", "x")]
    return table(spark, rows, "doc_id long, text string, score string").withColumns({"n_tokens": F.lit("clash"), "ids": F.lit(1), "n_lines": F.lit(2)})


def empty(spark):
    return table(spark, [], "doc_id long, text string, lang string")


def test_licences(spark, odd):
    texts = ["Licensed under the Apache License, Version 2.0. Foo. You may not use this file except in compliance with the License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of x.\nThe above copyright notice and this permission notice shall be included in all.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.", "licensed under foo licence. Licensed under CC BY-NC 4.0.", "no law here", None]
    got = license_scan.scan_licences(table(spark, list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licences for r in got] == ["Apache-2.0", "MIT", "CC-BY-NC", "", ""]
    assert [r.sentence_ids for r in got] == ["apacheVer2,apacheMayNotUse", "mitGrant,mitNotice,asIsMit", "unknown,ccByNc", "", ""]
    assert license_scan.scan_licences(odd).count() == odd.count() and license_scan.scan_licences(empty(spark)).count() == 0


def brute_components(sets, num, den):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, num):
    rng = random.Random(k)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 60, 200]))] for _ in range(25)]
    texts = [None, "", "One two", "one TWO", "one"]
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\t".join(w))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    want = brute_components(sets, num, 100)
    docs = table(spark, list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.near_components(docs, k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_jaccard_chunks_and_odd(spark, odd, monkeypatch):
    """Lists that are cut into several chunks lose no link, and odd tables keep every row."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 2)
    rng = random.Random(1)
    w = [f"w{i}" for i in range(80)]
    texts = [" ".join(w[:j] + [f"x{j}"] + w[j + 1 :]) for j in rng.sample(range(80), 20)]
    got = jaccard_join.near_components(table(spark, list(enumerate(texts)), "doc_id long, text string"), 4, 85, 100).collect()
    sets = [{tuple(t.split()[i : i + 4]) for i in range(77)} for t in texts]
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(brute_components(sets, 85, 100)))
    assert jaccard_join.near_components(odd, 4, 85, 100).count() == odd.count()
    assert jaccard_join.near_components(empty(spark), 4, 85, 100).count() == 0


def test_jaccard_lists_hold_sets_near_in_size_alone(spark, monkeypatch):
    """op2_jaccard_join, disk: sets of one list that are too far apart in size are not carried on, nor token lists once indexed."""
    seen, gone, put, drop = {}, [], jaccard_join.Staging.put, jaccard_join.Staging.drop

    def kept(self, df, name):
        out = put(self, df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join.Staging, "put", kept)
    monkeypatch.setattr(jaccard_join, "bucket_classes", lambda *_: np.zeros(1 << 16, np.uint8))
    monkeypatch.setattr(jaccard_join.Staging, "drop", lambda self, *names: (gone.extend(names), drop(self, *names)))
    # one common shingle in all, beside others: a short text, two of about the same size, and one much longer
    texts = ["a b c d"] + ["a b c d " + " ".join(f"w{n}x{i}" for i in range(n)) for n in (20, 21, 300)]
    rows = jaccard_join.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=4, num=10, den=100).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert seen["shared"] == 2 and {"sets", "classes"} <= set(gone)


def test_list_pairs_finds_every_link_of_a_list(spark):
    """Without any component known, each chunking of one list gives the same pairs."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    rows = [(7, p, i, len(s), 0, i, jaccard_join.bitmap(s)) for p in (1, 3) for i, s in enumerate(sets)]
    df = table(spark, rows, "tok long, part long, rep long, n long, pos int, comp long, bits binary")
    one, three = ({tuple(r) for r in jaccard_join.list_pairs(df.filter(F.col("part") == p), 1, 2).collect()} for p in (1, 3))
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))}
    assert one == three and want <= one
    # one pair of each two components, of those that may be linked
    grouped = df.filter("part = 1").withColumn("comp", F.col("rep") % 4)
    likely = {tuple(r) for r in jaccard_join.list_pairs(grouped, 1, 2, one=True).collect()}
    every = {tuple(r) for r in jaccard_join.list_pairs(grouped, 1, 2).collect()}
    assert likely <= every and sorted({tuple(sorted((a % 4, b % 4))) for a, b in every}) == sorted(tuple(sorted((a % 4, b % 4))) for a, b in likely)


def smith_waterman(a, b):
    best, old = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, old[j] + (2 if x == y else -1), old[j + 1] - 1, new[j] - 1))
        best, old = max(best, *new), new
    return best


def test_alignment_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        score, first, last = decontaminate.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        if score:
            assert smith_waterman(a.tolist(), b[first:last].tolist()) == score


def test_leaks(spark, odd):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(12)]
    docs, want = [], set()
    for d in range(60):
        w = [word() for _ in range(200)]
        if d % 3 == 0:
            edited = [x if rng.random() > 0.12 else word() for x in items[d % 12]]
            w[50:50] = edited
            want.add((d, d % 12))
        docs.append((d, " ".join(w).capitalize() + "."))
    bench = table(spark, [(i, " ".join(x) + "!") for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "too short"), (None, "a b c d e f g h")], "item_id long, text string")
    found = decontaminate.find_leaks(table(spark, docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and all(0.5 <= r.score <= 1 for r in found)
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0 and decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(table(spark, docs, "doc_id long, text string"), bench).count() == 40


def test_leaks_without_hits_in_some_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 20)
    bench = table(spark, [(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(3)], "item_id long, text string")
    docs = table(spark, [(0, "nothing here"), (1, " ".join(f"q1x{j}" for j in range(20)))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 1, 1.0)]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SUBTREE", 60)
    monkeypatch.setattr(mtree, "PAGE", 8)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 6))
    v[100:180] = v[0]  # copies: ties go to the smaller id
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6)]
    got = mtree.top_k(table(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect()
    q = np.floor(256 * v).astype(int)
    want = set()
    for i in range(0, 400, 20):
        s = q @ q[i]
        best = sorted((-s[j], j) for j in range(400) if j != i)[:5]
        want |= {(i, r, j, -x) for r, (x, j) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want
    few = mtree.top_k(table(spark, rows[:3], "vec_id long, embedding array<double>"), F.lit(True), 5).collect()
    assert len(few) == 6
    assert mtree.top_k(table(spark, [], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_language(spark, odd):
    words = {"aa": "the and of to in is that for it with", "bb": "der die und das nicht von sie ist des sich", "cc": "los las que del para una por con como más"}
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(40)), k) for i, k in enumerate(list(words) * 40)]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(docs.filter(~language_id.held_out(F.col("doc_id"))))
    got = language_id.identify(docs, profiles).collect()
    assert all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in got)
    said = language_id.identify(odd, profiles).collect()
    assert len(said) == odd.count() and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in said)
    assert language_id.learn_profiles(empty(spark)) == {} and language_id.identify(odd, {}).filter("lang_pred <> 'und'").count() == 0


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_count.count_tokens(odd, P.path("word_bpe_49k.json"), limit=20).collect()
    assert len(got) == odd.count()
    for r in got:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 20)
    count = token_count.PrefixCounter(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    for w in ("unbelievably", "thwhonesorerat", "aaaaaaaa", "日本語"):
        ends = [len(w[:i].encode()) for i in range(len(w) + 1)]
        assert [count.prefix_counts(w)[e] for e in ends] == [len(library.encode(w[:i], add_special_tokens=False).ids) for i in range(len(w) + 1)]


def test_line_dedup(spark, odd):
    rows = [(i, f"Same LINE \nown {i}\n\n") for i in range(12)] + [(50, None), (51, "same line"), (52, "É x"), (53, "é x"), (None, "\tSAME line\r\nkept")]
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(table(spark, rows, "doc_id long, text string"), min_docs=10).collect()}
    assert got[0].text == "own 0\n\n" and (got[0].n_lines, got[0].n_dropped) == (4, 1)
    assert (got[50].text, got[50].n_lines, got[51].text, got[52].text, got[None].text) == ("", 1, "", "É x", "kept")
    out = line_dedup.drop_common_lines(odd, min_docs=2)
    assert out.count() == odd.count() and out.filter("text = 'repeated id'").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("frequent", [0, 1 << 18])
def test_byte_bpe(spark, odd, frequent):
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(odd, RANKS, P.PATTERN, frequent=frequent, part=1.0, decoded=True).drop("text").join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) >= odd.count() - 3
    by_id = {i: t for i, t in enumerate(ODD)}
    for r in got:
        if r.doc_id in by_id and r.doc_id != 3:
            ids = library.encode_ordinary(by_id[r.doc_id] or "")
            assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
            assert bytes(r.decoded) == (by_id[r.doc_id] or "").encode()
    again = byte_bpe.decode(table(spark, [(1, bytearray(struct.pack("<2I", 10, 300)))], "doc_id long, ids binary"), RANKS).first()
    assert bytes(again.decoded) == library.decode_bytes([10, 300])
    assert byte_bpe.encode(empty(spark), RANKS, P.PATTERN).count() == 0


def test_long_words_merge_as_the_library_does():
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for n in (1, 2, 50, 400):
        w = "".join(rng.choice("abcdetion") for _ in range(n))
        assert byte_bpe.merge_long(w.encode(), ranks) == library.encode_ordinary(w)


def test_toxicity(spark, odd):
    rng = random.Random(6)
    fill = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choices(fill, k=60) + (rng.choices(["vile", "nasty", "foul"], k=3) if bad else []))))
        if i % 4:
            labels.append((i, int(bad)))
    docs, marks = table(spark, rows, "doc_id long, text string"), table(spark, labels + [(None, 1), (399, None), (398, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.filter(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score_documents(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) and 0 <= r.score <= 1 for r in got)
    said = toxicity.score_documents(odd, model)
    assert said.count() == odd.count() and said.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_documents(docs, toxicity.fit(docs, marks.limit(0))).filter("score <> 0").count() == 0
    for text in [r[1] for r in rows[:40]]:  # block bounds lose no neighbour
        known = {t: n for t, n in toxicity.Counter(toxicity.words(text)).items() if t in model.number}
        term, value = model.vector(known)
        scores: dict[int, float] = {}
        for t, v in zip(term.tolist(), value.tolist(), strict=True):
            for e, w in zip(*model.lists.get(t, ([], [])), strict=True):
                scores[int(e)] = scores.get(int(e), 0.0) + v * w
        want = sorted(((round(float(s), 12), e) for e, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[: model.k]
        assert [e for _, e in model.nearest(term, value)] == [e for _, e in want]


def test_packing(spark, odd):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    docs = table(spark, [(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = packing.pack_documents(docs, RANKS, P.PATTERN, capacity=64).collect()
    assert len({r.pack for r in rows}) == len(rows)
    parts = {}
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(pos) == r.n_tokens == r.cu_seqlens[-1] <= 64
        for d, p, o, a, b in zip(r.doc_ids, r.pieces, r.offsets, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert o == 64 * p and pos[a:b].tolist() == list(range(b - a)) and (d, p) not in parts
            parts[d, p] = ids[a:b].tolist()
    for i, t in enumerate(ODD):
        assert sum((parts.get((i, p), []) for p in range(999)), []) == library.encode_ordinary(t or "")
    assert packing.pack_documents(odd, RANKS, P.PATTERN).count() > 0 and packing.pack_documents(empty(spark), RANKS, P.PATTERN).count() == 0


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(8)
    for _ in range(60):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        free, plain = [], 0
        for s in sorted(sizes, reverse=True):
            fit = [i for i, f in enumerate(free) if f >= s]
            if fit:
                i = min(fit, key=lambda i: free[i])
                free[i] -= s
            else:
                free.append(50 - s)
        rows = packing.best_fit_decreasing(sizes, 50)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes))) and all(sum(sizes[i] for i in r) <= 50 for r in rows)
        assert sorted(50 - sum(sizes[i] for i in r) for r in rows) == sorted(free)


def edited(rng, words, share, new):
    """The words with about the given share of them changed, dropped or followed by a new one."""
    out = []
    for w in words:
        kind = rng.choice("ccda") if rng.random() < share else ""
        out += {"": [w], "c": [new()], "d": [], "a": [w, new()]}[kind]
    return out


def test_leaks_equal_plain_alignment(spark):
    """Copies with 20 to 35% edited words, some without any intact seed: what aligning each item with each text finds."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(12)]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (6, 8, 12, 20, 38, 38, 59)]
    texts = []
    for d in range(140):
        copy = edited(rng, items[d % 7], rng.choice([0.2, 0.25, 0.3, 0.35]), word)
        texts.append([word() for _ in range(rng.randrange(40))] + copy + [word() for _ in range(40)])
    texts.append([w if i % 6 else "changed" for i, w in enumerate(items[4])])  # one in six breaks half of the seeds
    texts.append([w if i % 3 else "changed" for i, w in enumerate(items[6])])  # no seed is left
    texts.append([x for w in items[5] for x in (w, "added")])  # not even two words stand together
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            if (s := smith_waterman(item, text) / (2 * len(item))) >= 0.5:
                want[d, i] = s
    assert len(want) > 90 and {(140, 4), (141, 6), (142, 5)} <= set(want)
    bench = table(spark, [(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.find_leaks(table(spark, [(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == want


def test_leaks_fold_case_beyond_ascii(spark):
    bench = table(spark, [(1, "ÉTÉ ÜBER ÑANDÚ ΣΟΦΟΣ ЖИЗНЬ ÅR ØL")], "item_id long, text string")
    docs = table(spark, [(1, "été über ñandú σοφος жизнь år øl")], "doc_id long, text string")
    assert [r.score for r in decontaminate.find_leaks(docs, bench).collect()] == [1.0]


KNOWN = {
    "spdx": "SPDX License Identifier MIT", "apacheVer2": "Licensed under the Apache License, Version 2.0", "apacheMayNotUse": "you may not use this file except in compliance with the License",
    "apacheObtain": "You may obtain a copy of the License at", "asIsBasis": "distributed under the License is distributed on an AS IS basis", "seeLicense": "See the License for the specific language governing permissions and limitations",
    "mitName": "Released under the MIT License", "mitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy", "mitNotice": "The above copyright notice and this permission notice shall be included",
    "asIsMit": "The software is provided as is, without warranty of any kind", "bsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted", "bsdSource": "Redistributions of source code must retain the above copyright notice",
    "bsdBinary": "Redistributions in binary form must reproduce the above copyright notice", "bsdEndorse": "may be used to endorse or promote products x without specific prior written permission", "bsdName": "Released under the BSD License",
    "agpl3": "Licensed under the GNU Affero General Public License, version 3", "lgpl21": "Licensed under the GNU Lesser General Public License, version 2.1", "lgpl3": "Licensed under the GNU Lesser General Public License, version 3",
    "gpl2": "Licensed under the GNU General Public License, version 2", "gpl3": "Licensed under the GNU General Public License, version 3", "gplRedistribute": "You can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gplWarranty": "without even the implied warranty of merchantability or fitness", "ccByNcNd": "Licensed under CC BY-NC-ND", "ccByNcSa": "Licensed under CC BY-NC-SA", "ccByNc": "Licensed under CC BY-NC", "ccBySa": "Licensed under CC BY-SA", "ccBy": "Licensed under CC BY",
    "cc0": "Released under CC0 1.0", "mozilla2": "subject to the terms of the Mozilla Public License, version 2.0", "allRights": "All rights  reserved", "copyright": "Copyright 2024 Foo",
    "iscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "asIsIsc": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    "zlibAsIs": "This software is provided 'as-is', without any express or implied warranty", "zlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications",
    "unlicense": "This is free and unencumbered software released into the public domain", "boostGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "asIsBsd": "This software is provided by the copyright holders and contributors \"as is\" without warranties", "lgplRedistribute": "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "agplRedistribute": "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "lgpl21Redistribute": "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License".replace(";", ","),
    "lgpl3Redistribute": "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "agpl3Redistribute": "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "gpl2Redistribute": "modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
    "gpl3Redistribute": "modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "eitherVersion2": "either version 2 of the License, or (at your option) any later version", "eitherVersion21": "either version 2.1 of the License", "eitherVersion3": "either version 3 of the License",
    "gplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "gplReceived": "You should have received a copy of the GNU General Public License along with this program", "gplSee": "If not, see <https://www.gnu.org/licenses/>",
    "gfdlGrant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "oflGrant": "This Font Software is licensed under the SIL Open Font License",
}
NAMED = {
    "0BSD": "Zero-Clause BSD License", "AFL-3.0": "Academic Free License v3.0", "Apache-1.1": "Apache Software License, Version 1.1", "APSL-2.0": "Apple Public Source License 2.0", "Artistic-1.0": "Artistic License 1.0", "Artistic-2.0": "Artistic License 2.0", "BlueOak-1.0.0": "Blue Oak Model License",
    "BSL-1.0": "Boost Software License", "BUSL-1.1": "Business Source License", "CDDL-1.0": "Common Development and Distribution License 1.0", "CECILL-2.1": "CeCILL Free Software License v2.1", "CPAL-1.0": "Common Public Attribution License", "CPL-1.0": "Common Public License", "curl": "curl license",
    "ECL-2.0": "Educational Community License", "EFL-2.0": "Eiffel Forum License", "Elastic-2.0": "Elastic License 2.0", "EPL-1.0": "Eclipse Public License v1.0", "EPL-2.0": "Eclipse Public License, version 2.0", "EUPL-1.1": "European Union Public Licence 1.1", "EUPL-1.2": "European Union Public License v1.2",
    "GFDL-1.3": "GNU Free Documentation License 1.3", "HPND": "Historical Permission Notice and Disclaimer License", "IPL-1.0": "IBM Public License", "ISC": "ISC License", "LPPL-1.3c": "LaTeX Project Public License", "MIT-0": "MIT No Attribution License", "MPL-1.1": "Mozilla Public License 1.1",
    "MPL-2.0": "Mozilla Public License 2.0", "MS-PL": "Microsoft Public License", "MS-RL": "Microsoft Reciprocal License", "MulanPSL-2.0": "Mulan Permissive Software License", "NCSA": "University of Illinois/NCSA Open Source License", "NPL-1.1": "Netscape Public License", "ODbL-1.0": "Open Database License",
    "ODC-By-1.0": "Open Data Commons Attribution License", "OFL-1.1": "Open Font License", "OpenSSL": "OpenSSL License", "OSL-3.0": "Open Software License 3.0", "PHP-3.01": "PHP License", "PostgreSQL": "PostgreSQL License", "Python-2.0": "Python Software Foundation License", "QPL-1.0": "Q Public License",
    "Ruby": "Ruby License", "Sleepycat": "Sleepycat License", "SSPL-1.0": "Server Side Public License", "Unlicense": "Unlicense", "UPL-1.0": "Universal Permissive License", "Vim": "Vim License", "W3C": "W3C Software Notice and License", "WTFPL": "WTFPL License", "X11": "X11 License", "Zlib": "zlib License", "ZPL-2.1": "Zope Public License",
}


def test_named_licences(spark):
    """Each named licence is found where a text is under its terms, wrapped or not, and where its name stands alone."""
    rows = [(k, t) for k, name in NAMED.items() for t in (f"Foo is released under the terms of the {name}.", f"Foo\nis licensed under the\n{name}\n", f"{name}\n\nfoo bar")]
    got = license_scan.scan_licences(table(spark, rows, "want string, text string")).collect()
    assert set(NAMED) == set(license_scan.NAMES) and [(r.want, r.text) for r in got if r.licences != r.want] == []


def test_every_known_sentence_passes_the_cues(spark):
    names = [n for n, _ in license_scan.SENTENCES if n.removeprefix("is") not in NAMED]
    got = license_scan.scan_licences(table(spark, [(i, KNOWN[n] + ".") for i, n in enumerate(names)] + [(-1, "token acc0f")], "doc_id long, text string")).collect()
    assert {names[r.doc_id]: r.sentence_ids for r in got if r.doc_id >= 0} == {n: n for n in names}
    assert {names[r.doc_id]: r.licences for r in got if names[r.doc_id] in ("allRights", "cc0")} | {r.text: r.licences for r in got if r.licences and r.doc_id < 0} == {"allRights": "Proprietary", "cc0": "CC0"}


MIT = """Copyright (c) 2024 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
BSD = """Copyright (c) 2024, Foo
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_wrapped_licences(spark):
    mark = lambda text, sign: "\n".join(sign + line for line in text.split("\n"))
    texts = {
        "MIT": [MIT, mark(MIT, " * ")], "Proprietary,BSD-2-Clause": [BSD, mark(BSD, "// ")], "Apache-2.0": [APACHE, mark(APACHE, "# "), "// SPDX-License-Identifier: Apache-2.0\nint x;", "/* spdx-license-identifier: apache-2.0 */"],
        "GPL-3.0": [GPL, mark(GPL, "# ")], "GPL-2.0-only WITH Classpath-exception-2.0": ["# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\n"], "MIT,CC-BY-SA": ["Released under the MIT license\nlicensed under Creative Commons Attribution\nShareAlike 4.0"],
        "Apache-2.0,MIT": ["Copyright 2020 Foo\nLicensed under the Apache License,\nVersion 2.0\n\nfoo licence\n\nreleased under the mit license"],
    }
    rows = [(k, t) for k, v in texts.items() for t in v]
    got = {(r.want, r.text): (r.licences, r.sentence_ids) for r in license_scan.scan_licences(table(spark, rows, "want string, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: k[0] for k in got} and len(got) == len(rows)
    assert got["MIT", MIT][1] == "copyright,mitGrant,mitNotice,asIsMit"
    assert got["Apache-2.0,MIT", rows[-1][1]][1] == "copyright,apacheVer2,unknown,mitName"


def test_many_lines_without_sentence_ends(spark):
    text = "\n".join(f"row {i} of a licence list" for i in range(3000)) + "\nReleased under the\nMIT license"
    r = license_scan.scan_licences(table(spark, [(1, text)], "doc_id long, text string")).first()
    assert r.licences == "MIT"


GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
LGPL = """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
"""


def test_what_a_sentence_says_of_a_licence(spark):
    """Denials, prose on other software, names that are no licence, versions, and SPDX expressions."""
    texts = [
        ("", "This project is not licensed under the MIT license."), ("", "It was never released under the Apache License, Version 2.0."), ("", "The code isn't licensed under CC BY-SA 4.0."), ("", "No longer available under the terms of the Elastic License 2.0."),
        ("", "Most React code is released under the MIT license, whereas ours is closed."), ("", "Some other packages are licensed under the BSD license."), ("", "Unlike Foo, which is licensed under the GNU General Public License, version 3, this costs money."),
        ("", "The cc0 variable counts columns in the license table."), ("CC0", "CC0 1.0 Universal\n\nfoo"), ("CC0", "Waived under CC0."), ("CC0", "Released under the Creative Commons CC0 license"),
        ("MIT", "This is licensed under the MIT license, not the GPL."), ("MIT", "Foo is not hard to use.\nFoo is released under the MIT license."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
        ("GPL-3.0", GPL), ("GPL-2.0", GPL2), ("LGPL-3.0", LGPL), ("GPL", "You can redistribute it and/or modify it under the terms of the GNU General Public License."),
        ("Apache-2.0,MIT", "// SPDX-License-Identifier: (Apache-2.0 AND MIT)\n"), ("GPL-2.0-only,MIT", "SPDX-License-Identifier: GPL-2.0-only OR MIT"), ("BSD-3-Clause,Apache-2.0,MIT", "# SPDX-License-Identifier: bsd-3-clause and (apache-2.0 or mit)"),
    ]
    got = license_scan.scan_licences(table(spark, texts, "want string, text string")).collect()
    assert [(r.want, r.text, r.licences) for r in got if r.want != r.licences] == []
