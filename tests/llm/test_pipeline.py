"""The pipeline over a small corpus whose right outcome is known, held against plain Python."""

import random
import struct

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")

WORDS = {"aa": "the and of to in is that for it with was on are as", "bb": "der die und das nicht von sie ist des sich mit dem ein auf"}


def corpus():
    rng = random.Random(11)

    def text(lang, n=60):
        return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "ab", "or", "en"]) for _ in range(n))

    items = [text("aa", 25) for _ in range(4)]
    docs, fate = [], {}

    def add(body, lang, kept):
        docs.append((len(docs), body, lang, "s", len(body or "")))
        fate[len(docs) - 1] = kept

    for i in range(40):
        lang = "aa" if i % 2 else "bb"
        add(text(lang) + "\n" + ("Shared footer line " if i < 20 else "own line " + text(lang, 5)), lang, True)
    near = text("aa", 120).split()
    for i in range(6):  # one group of near copies: the first stays
        copy = list(near)
        copy[10 * i] = f"edit{i}"
        add(" ".join(copy), "aa", i == 0)
    exact = text("bb", 30)
    for i in range(4):
        add(exact, "bb", i == 0)
    for item in items:
        add(text("aa", 40) + " " + item + " " + text("aa", 40), "aa", False)
    for odd in (None, "", "12345 !!!", "\n\n"):
        add(odd, None, False)
    return docs, items, fate


def test_pipeline(spark, tmp_path):
    import tiktoken

    docs, items, fate = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {i for i, kept in fate.items() if kept}
    from yardspark.llm.byte_bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in out.items():
        body = docs[i][1]
        if body.endswith("Shared footer line "):
            body = body.rsplit("\n", 1)[0]  # twenty documents share the line
        ids = library.encode_ordinary(body)
        assert (bytes(r.ids), r.n_tokens, r.lang) == (struct.pack(f"<{len(ids)}I", *ids), len(ids), docs[i][2])


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items, _ = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame.limit(8), str(tmp_path)).columns == corpus_pipeline.COLUMNS


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Repeated and null ids are judged by their texts, further columns are left out, an empty table gives an empty one."""
    words = "the and of to in is that for it with was on are as".split()
    rng = random.Random(5)
    body = lambda: " ".join(rng.choice(words) + rng.choice(["", "ab", "or", "en"]) for _ in range(50))
    one, two, item = body(), body(), body()
    rows = [(1, one), (1, one), (1, two), (None, one), (None, body()), (9, f"{body()} {item}"), (9, body())] + [(20 + i, body()) for i in range(10)]
    docs = [(i, t, "aa", "s", len(t), "more") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    for name, part in (("some", docs), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 1, 9, *range(20, 30)]
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
