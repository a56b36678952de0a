"""The training-data operators that SQL cannot express against plain Python, on small tables with nulls, ties and repeats."""

import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from yardspark.llm import _pretokens, byte_bpe, decontaminate, language_id, line_dedup, mtree, packing, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def grams(text):
    """Counts of 1- to 3-grams by definition; a run of other signs than letters is one blank."""
    line = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    while "  " in line:
        line = line.replace("  ", " ")
    code = [0 if c == " " else ord(c) for c in line]
    out = Counter()
    if len(code) > 1:
        out.update(c for c in code if c)
        out.update((1 << 60) | a << 20 | b for a, b in zip(code, code[1:]))
        out.update((1 << 61) | a << 40 | b << 20 | c for a, b, c in zip(code, code[1:], code[2:]) if b)
    return out


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_language_by_definition(spark):
    """Profiles, distances and ties as the definition has them, also for letters far apart that share low bits."""
    rng = random.Random(3)
    letters = {"aa": "abcdeé", "bb": "abcfgß", "cc": "абвгд", "dd": chr(0x4E00) + chr(0x4E00 + 1021) + "日本語"}
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randrange(1, 6)))
    rows = [(i, " ".join(word(k) for _ in range(rng.randrange(1, 30))), k) for i, k in enumerate(list(letters) * 15)]
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (902, "abc", None), (903, "", "cc")]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    size = 60
    want = {k: Counter() for k in letters}
    for _, t, k in rows:
        if k and t is not None:
            want[k].update(grams(t))
    profiles = {k: ranked(v, size) for k, v in want.items()}
    got = language_id.learn_profiles(docs, size=size)
    assert got == profiles
    for r in language_id.identify(docs, got, size=size).collect():
        own = ranked(grams(r.text), size)
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        apart = {k: sum(abs(v.index(g) - i) if g in v else size for i, g in enumerate(own)) for k, v in profiles.items()}
        best = min(sorted(apart), key=lambda k: apart[k])
        assert r.lang_pred == best and abs(r.score - (1 - apart[best] / (size * len(own)))) < 1e-12


def test_toxicity_by_definition(spark):
    """Every score from plain cosines of all examples and their votes; a held-out calibration on top."""
    rng = random.Random(6)
    fill = [f"w{i}" for i in range(150)]
    rows, marks = [], []
    for i in range(300):
        bad = i % 6 == 0
        rows.append((i, " ".join(rng.choices(fill, k=rng.randrange(5, 60)) + (rng.choices(["vile", "nasty", "foul"], k=rng.randrange(1, 4)) if bad else []))))
        marks.append((i, int(bad)))
    rows += [(400, None), (401, ""), (402, "w1 w1 w1")]
    docs, labels = table(spark, rows, "doc_id long, text string"), table(spark, marks, "doc_id long, toxic int")
    learnt = labels.filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, learnt)
    ids = sorted(r.doc_id for r in learnt.collect())
    text, mark = dict(rows), dict(marks)
    counts = {i: Counter(toxicity.words(t)) for i, t in rows}
    frequency = Counter(w for c in counts.values() for w in c)
    idf = {t: math.log((1 + len(rows)) / (1 + frequency[t])) + 1 for t in model.terms}

    def vector(c):
        v = {t: (1 + math.log(c[t])) * idf[t] for t in model.terms if c[t]}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()}

    vectors = {i: vector(counts[i]) for i in ids}
    bare = [i for i in ids if not vectors[i]]
    base = sum(mark[i] for i in ids) / len(ids)
    prior = (sum(mark[i] for i in bare) + base) / (len(bare) + 1)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    for i, _ in rows:
        own = vector(counts[i])
        near = sorted(((-round(sum(x * vectors[e].get(t, 0.0) for t, x in own.items()), 12), e) for e in ids))[: model.k]
        votes = [(-s, mark[e]) for s, e in near if s < 0]
        want = (sum(s for s, y in votes if y) + model.smooth * prior) / (sum(s for s, _ in votes) + model.smooth) if own else prior
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == int(want >= 0.5), (i, text[i])
    held = [(got[i].score, mark[i]) for i, _ in marks if i not in set(ids)]
    rate = sum(y for _, y in held) / len(held)  # Brier score, against that of the base rate alone
    assert len(held) > 40 and sum((s - y) ** 2 for s, y in held) / len(held) < rate * (1 - rate) / 2


def test_clean_documents_judges_rows(spark):
    """Null and repeated ids do not matter; items may have any kind of id; several parts find what one part finds."""
    item = " ".join(f"q{j}" for j in range(20))
    rows = [(None, f"a {item} b", "x"), (1, "clean text of its own", "x"), (1, item, "x"), (None, "other clean text", "x"), (2, None, "x"), (3, "", "x")]
    docs = table(spark, rows, "doc_id long, text string, score string")
    bench = table(spark, [("i1", item), ("i1", "z " * 20), (None, "y " * 9)], "item_id string, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.clean_documents(docs, bench).collect()) == [(0, "other clean text"), (1, "clean text of its own"), (2, ""), (3, "")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == {(None, "i1"), (1, "i1")}


def test_parts_of_a_benchmark(spark, monkeypatch):
    rng = random.Random(1)
    items = [" ".join(f"v{rng.randrange(300)}" for _ in range(15)) for _ in range(12)]
    docs = table(spark, [(i, f"x y {t} z") for i, t in enumerate(items)] + [(50, "x y z")], "doc_id long, text string")
    bench = table(spark, list(enumerate(items)), "item_id long, text string")
    one = {tuple(r) for r in decontaminate.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 40)
    assert {tuple(r) for r in decontaminate.find_leaks(docs, bench).collect()} == one and {(r[0], r[1]) for r in one} >= {(i, i) for i in range(12)}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()] == [50]


def test_top_k_with_repeated_ids(spark):
    """Rows of one id are no candidates of each other; each of them is one of other queries."""
    rows = [(0, [1.0, 0.0])] * 4 + [(0, [0.0, 1.0])] + [(i, [1.0, 1.0]) for i in range(1, 8)] + [(3, [1.0, 1.0])]
    got = mtree.top_k(table(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 2, 5).collect()
    zero = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    assert zero == sorted([(r, v, 65536) for r, v in zip(range(1, 6), (1, 2, 3, 3, 4), strict=True)] * 2)  # two distinct vectors
    assert [(r["rank"], r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == 1), key=lambda r: r["rank"])] == [(1, 2, 131072), (2, 3, 131072), (3, 3, 131072), (4, 4, 131072), (5, 5, 131072)]
    with pytest.raises(ValueError, match="2\\^53"):
        mtree.top_k(table(spark, [(1, [1e7])], "vec_id long, embedding array<double>"), F.lit(True))


def test_line_dedup_names_and_many_common_lines(spark):
    """Columns of any name stay, and few or no broadcast lines give the same result."""
    rows = [(i % 20, f"both\nmany {i % 3}\nown {i}", "k", "h", "i") for i in range(60)] + [(None, "both\nnull", "k", "h", "i")]
    docs = table(spark, rows, "doc_id long, text string, _kept string, _hot string, _id string").withColumns({"key": F.lit(1), "lines": F.lit(2)})
    outs = [sorted((r.doc_id or -1, r.text, r.n_lines, r.n_dropped, r._kept, r._hot, r._id, r.key, r.lines) for r in line_dedup.drop_common_lines(docs, min_docs=10, most=m).collect()) for m in (1 << 17, 1, 0)]
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == 61
    assert all(r[1] == "null" or r[1].startswith("own ") for r in outs[0]) and all(r[4:7] == ("k", "h", "i") for r in outs[0])


def test_chunks_are_independent():
    """Cutting a text into chunks, by bytes or by the pattern, never changes its pretokens."""
    rng, split = random.Random(2), _pretokens.splitter(P.PATTERN)
    for _ in range(4000):
        kinds = "ab  \n\t.é 日'sX1,(-_t 　" if rng.random() < 0.3 else "ab  \n\t.éX1',-s"
        texts = ["".join(rng.choice(kinds) for _ in range(rng.randrange(0, 25))) for _ in range(rng.randrange(0, 4))]
        found = _pretokens.Chunks([t.encode() for t in texts])
        names, at = found.take(np.arange(len(found.code))), 0
        for t, n in zip(texts, found.per_text.tolist(), strict=True):
            assert [w for i in found.number[at : at + n] for w in split(names[i].decode())] == split(t)
            at += n
        again = _pretokens.Chunks.of(names)
        assert (again.code == found.code).all() and (again.check == found.check).all() and len(set(names)) == len(names)
    text = ("word é  x" * 3000).encode()
    assert b"".join(_pretokens.segments(text, 500)) == text and len(_pretokens.segments(text, 500)) > 5


def test_byte_bpe_odd_rows(spark):
    """Null and repeated ids, and columns of the operator's own names."""
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rows = [(None, "nulls have texts too", 1), (3, "repeated", 2), (3, "repeated", 2), (4, None, 3), (5, "zqxjkvbp " * 3 + " x  　y", 4), (6, "ab " * 300_000 + "tail", 5), (7, "a \0b \0c\xa0d", 6), (8, "x　y \0one z \0two", 7)]
    docs = table(spark, rows, "doc_id long, text string, open long").withColumns({"folded": F.lit("f"), "c0": F.lit("c"), "places": F.lit("p")})
    got = byte_bpe.encode(docs, RANKS, P.PATTERN, part=1.0).collect()
    assert len(got) == len(rows) and {(r.folded, r.c0, r.places) for r in got} == {("f", "c", "p")}
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_packing_of_one_long_and_repeated_rows(spark):
    import tiktoken

    nul = "a \0b \0c\xa0d x　y \0one z \0two"
    rows = [(7, "same words here")] * 3 + [(None, "no id"), (8, "x y " * 2000), (9, nul)]
    out = packing.pack_documents(table(spark, rows, "doc_id long, text string"), RANKS, P.PATTERN, capacity=64).collect()
    held = Counter((d, p) for r in out for d, p in zip(r.doc_ids, r.pieces, strict=True))
    assert held[7, 0] == 3 and held[None, 0] == 1 and all(n == 1 for (d, _), n in held.items() if d == 8)
    got = [r.input_ids[4 * a : 4 * b] for r in out for d, a, b in zip(r.doc_ids, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True) if d == 9]
    ids = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}).encode_ordinary(nul)
    assert [bytes(x) for x in got] == [struct.pack(f"<{len(ids)}I", *ids)]


def test_toxicity_with_ids_of_other_types(spark):
    """Evidence holds the ids as they are; of several texts under one id the first by text is learnt from."""
    rows = [(f"d{i}", "vile words here" if i % 3 == 0 else "kind words here") for i in range(60)] + [("d3", "zz other text")]
    docs, labels = table(spark, rows, "doc_id string, text string"), table(spark, [(f"d{i}", int(i % 3 == 0)) for i in range(60)], "doc_id string, toxic int")
    model = toxicity.fit(docs.repartition(5), labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs.filter("text not like 'zz%'"), model).collect()}
    assert len(got) == 60 and all(r.predicted == int(int(i[1:]) % 3 == 0) and set(r.evidence) <= set(got) for i, r in got.items())
    assert toxicity.fit(docs.repartition(2), labels).lists.keys() == model.lists.keys() and got["d0"].evidence
