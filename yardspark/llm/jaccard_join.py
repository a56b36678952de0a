"""Exact Jaccard join of documents on word shingles, and the components of its links.

Prefix index: every distinct set is listed under the first tokens of one global order (tokens that fall into
heavily used hash buckets come last), so that two sets that reach the threshold share a listed token. Relations of
sets save work in two ways:

* Answers are derived from a similar set's. Equal sets are one class. Every list first proposes its members to two
  leaders; a member that is linked with a leader takes over the leader's component, and two sets that are in one
  component already are not compared any more. Then, for each two components that still meet in a list, a task compares the
  likeliest pair of their sets, and only lists in which components are left are searched for all pairs.
* Index lists are skipped by blocks. Lists whose sets are all in one component are dropped by an aggregate. In the
  others, blocks of sets are skipped by size and by position: a block whose sets stand too far down the list's order
  to reach the needed overlap is not opened.

What is left is bounded by bitmaps of the sets (exact upper bounds of the overlap) and then verified on the sets
themselves. No cap on candidates: long lists are cut into chunks and every pair of chunks is a task of its own.

Nulls and empty texts have no shingles and are linked with nothing; each keeps its own id as component. Rows with a
null id get a null component. A repeated id counts as one document whose rows are each linked by their own sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yardspark.llm._components import components
from yardspark.llm._staging import Staging
from yardspark.llm._words import shingle_sets, slices

#: Bits of the hash buckets whose use orders the tokens; their counts are all that reaches the driver.
_BUCKET_BITS = 16
#: Sets in one chunk of a list.
CHUNK = 1024
#: Pairs that a task remembers to have given.
SEEN = 200_000


def bucket_classes(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How heavily each hash bucket is used over all texts: 0 up to twice the mean, then by powers of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BUCKET_BITS, np.int64)
        for batch in batches:
            for _, raw in slices(batch.column(0)):
                for tokens in shingle_sets(raw, k):
                    if len(tokens):
                        np.add.at(total, (tokens >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << _BUCKET_BITS, np.int64)
    total[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return np.log2(np.maximum(total / max(1.0, total.mean()), 1)).astype(np.uint8)


def in_order(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Ascending tokens in the global order: by class of their bucket, then by hash."""
    c = classes[(tokens >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)]
    return tokens[np.argsort(c, kind="stable")] if c.any() else tokens


def prefix_length(n: int, num: int, den: int) -> int:
    return n + (num * n) // -den + 1


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts in as many buckets as there are tokens, about; widths are powers of two from 64."""
    width = max(64, 1 << int(len(tokens)).bit_length())
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at a smaller width."""
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def document_sets(docs: DataFrame, k: int, num: int, den: int, doc_id: str, text: str, classes: np.ndarray) -> DataFrame:
    """Per document: set size, two hashes of the whole set, its first tokens in the global order, and its bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in batches:
            for first, raw in slices(batch.column(1)):
                size, one, two, prefix, bits = [], [], [], [], []
                for tokens in shingle_sets(raw, k):
                    n = len(tokens)
                    size.append(n)
                    one.append(int(tokens.sum(dtype=np.uint64).astype(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(tokens * (tokens | np.uint64(1))).astype(np.int64)) if n else 0)
                    prefix.append(in_order(tokens, order)[: prefix_length(n, num, den)].view(np.int64) if n else np.empty(0, np.int64))
                    bits.append(bitmap(tokens) if n else None)
                ids = batch.column(0).slice(first, len(raw))
                lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(p) for p in prefix]).astype(np.int32), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists, pa.array(bits, pa.binary())], names=["doc_id", "n", "h", "g", "prefix", "bits"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, h long, g long, prefix array<long>, bits binary")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(rep, h, g, tokens): the whole sets of the wanted documents alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in slices(batch.column(1)):
                sets = [t.view(np.int64) for t in shingle_sets(raw, k)]
                lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(t) for t in sets]).astype(np.int32), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), lists], names=["rep", "tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).join(wanted, "rep", "left_semi")
    return rows.mapInArrow(run, "rep long, tokens array<long>").filter(F.size("tokens") > 0)


def near_in_size(index: DataFrame, num: int, den: int) -> DataFrame:
    """The index (rep, n, pos, tok) without sets that have no other of their list near in size; with each list's least and
    greatest set (lead, last).

    No link goes over a gap: where two sets that are next in size are too far apart, the list is cut in two.
    """
    by_size = Window.partitionBy("tok").orderBy("n")
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    rows = index.withColumns({"begins": F.coalesce(den * before < num * F.col("n"), F.lit(True)), "ends": F.coalesce(den * F.col("n") < num * after, F.lit(True))})
    rows = rows.filter(~(F.col("begins") & F.col("ends"))).withColumn("run", F.sum(F.col("begins").cast("int")).over(by_size))
    run = Window.partitionBy("tok", "run")
    rows = rows.withColumns({"lead": F.min("rep").over(run), "last": F.max("rep").over(run)}).filter(F.col("lead") < F.col("last"))
    # two runs of one name would only be compared in vain
    return rows.select("rep", "n", "pos", F.xxhash64("tok", "run").alias("tok"), "lead", "last")


def may_link(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow the threshold."""
    a, b = (sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")
    sized = pairs.join(a, "a").join(b, "b").filter((den * F.least("na", "nb") >= num * F.greatest("na", "nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
                w = min(x.shape[1], y.shape[1])
                keep.append(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum() <= most_apart(na + nb, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def most_apart(sizes, num: int, den: int):
    """The greatest symmetric difference that two sets of these sizes together can have at the threshold."""
    return sizes - 2 * (-(-num * sizes // (num + den)))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by their exact overlap."""
    a, b = (sets.select(F.col("rep").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.filter(den * shared >= num * (F.size("ta") + F.size("tb") - shared)).select("a", "b")


def list_pairs(rows: DataFrame, num: int, den: int, one: bool = False) -> DataFrame:
    """Pairs (a, b) of one list in different components that sizes, positions and bitmaps allow.

    rows: tok, part (number of chunks of the list), rep, n, pos, comp, bits. Every pair of chunks is a group. one: of
    two components a task gives the likeliest pair of the first blocks that have any, instead of all.
    """
    mine = F.pmod(F.xxhash64("rep"), F.col("part"))
    rows = rows.withColumn("c", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("part") - 1)))
    rows = rows.select("tok", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "rep", "n", "pos", "comp", "bits")
    dealt = rows.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j")

    def pairs_of(g: list[np.ndarray], bits: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(a, b, the one's component, the other's, how far apart their bitmaps are for their sizes) of each two blocks."""
        i, j, c, rep, n, pos, comp = g
        order = np.lexsort((rep, pos, n))
        c, rep, n, pos, comp = (x[order] for x in (c, rep, n, pos, comp))
        bits = [bits[x] for x in order]
        step = 64
        blocks = [slice(s, min(s + step, len(rep))) for s in range(0, len(rep), step)]
        for y in range(len(blocks)):
            later = blocks[y]
            for x in range(y, -1, -1):
                early = blocks[x]
                if den * n[early][-1] < num * n[later][0]:
                    break  # blocks before are smaller still
                need = -(-num * (n[early][0] + n[later][0]) // (num + den))
                if min((n[early] - pos[early]).max(), (n[later] - pos[later]).max()) < need:
                    continue  # no set of one of the blocks has enough tokens left
                na, nb = n[early][:, None], n[later][None, :]
                left = np.minimum(na - pos[early][:, None], nb - pos[later][None, :])
                good = (comp[early][:, None] != comp[later][None, :]) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
                good &= left * (num + den) >= num * (na + nb)
                if i[0] != j[0]:
                    good &= c[early][:, None] != c[later][None, :]
                if x == y:
                    good &= np.tri(*good.shape, -1, bool).T
                p, q = np.nonzero(good)
                if not len(p):
                    continue
                p, q = p + early.start, q + later.start
                keep, far = np.empty(len(p), bool), np.empty(len(p))
                widths = np.array([min(len(bits[u]), len(bits[v])) // 8 for u, v in zip(p, q, strict=True)])
                for w in np.unique(widths):
                    at = np.flatnonzero(widths == w)
                    used = np.unique(np.concatenate((p[at], q[at])))
                    table = np.concatenate([fold(np.frombuffer(bits[u], np.uint64)[None], w) for u in used])
                    apart = np.bitwise_count(table[np.searchsorted(used, p[at])] ^ table[np.searchsorted(used, q[at])]).sum(1)
                    keep[at] = apart <= most_apart(n[p[at]] + n[q[at]], num, den)
                    far[at] = apart / (n[p[at]] + n[q[at]])
                if keep.any():
                    p, q, far = p[keep], q[keep], far[keep]
                    yield np.minimum(rep[p], rep[q]), np.maximum(rep[p], rep[q]), np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q]), far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        seen: set[tuple[int, int]] = set()

        def unseen(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> list[tuple[int, int]]:
            """The pairs that this task has not given lately: near copies meet in many lists."""
            if len(seen) > SEEN:
                seen.clear()
            if one:
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for i in np.argsort(far, kind="stable").tolist():
                    best.setdefault((int(x[i]), int(y[i])), (int(a[i]), int(b[i])))
                new = {pair for both, pair in best.items() if both not in seen}
                seen.update(best)
            else:
                new = set(zip(a.tolist(), b.tolist(), strict=True)) - seen
                seen.update(new)
            return sorted(new)

        def groups(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            columns = [table.column(x).to_numpy() for x in ("tok", "i", "j", "c", "rep", "n", "pos", "comp")]
            key = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in columns[:3]], axis=0))))
            ends = [*key[1:], table.num_rows]
            held = None if last else table.slice(key[-1])
            bits = table.column("bits").to_pylist()
            for s, e in zip(key, ends, strict=True):
                if e - s > 1 and (last or e < table.num_rows):
                    for found in pairs_of([x[s:e] for x in columns[1:]], bits[s:e]):
                        if new := unseen(*found):
                            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from groups(pa.concat_tables([held, table]) if held else table, False)
        if held:
            yield from groups(held, True)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs: component_id is the smallest id reachable by links of num / den."""
    spark = docs.sparkSession
    stage = Staging(spark, "jaccard")
    classes = bucket_classes(docs, text, k)
    sets = stage.put(document_sets(docs, k, num, den, doc_id, text, classes), "sets")
    known = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = stage.put(known.groupBy("n", "h", "g").agg(F.min("doc_id").alias("rep")), "reps")
    firsts = known.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "h", "g"], "left_semi").dropDuplicates(["doc_id", "h", "g"])
    classes_ = stage.put(firsts.select(F.col("doc_id").alias("rep"), "n", "prefix", "bits"), "classes")
    # of what is kept on disk, the lists of tokens are the most: they go as soon as they are indexed
    keys = stage.put(sets.select("doc_id", "n", "h", "g"), "keys")
    stage.drop("sets")
    sketches = stage.put(classes_.select("rep", "n", "bits"), "sketches")
    index = classes_.select("rep", "n", F.posexplode("prefix").alias("pos", "tok"))
    shared = stage.put(near_in_size(index, num, den), "shared")
    stage.drop("classes")

    # two leaders, the least and the greatest set of the list: who misses one is mostly linked with the other
    proposed = F.explode(F.array(F.struct(F.col("lead").alias("a"), F.col("rep").alias("b")), F.struct(F.col("rep").alias("a"), F.col("last").alias("b"))))
    led = shared.select(proposed.alias("p")).select("p.a", "p.b").filter("a < b").distinct()
    maybe = stage.put(may_link(led, sketches, num, den), "led")
    known_sets = stage.put(full_sets(docs, _ends(maybe), k, doc_id, text), "led_sets")
    links = stage.put(verified(maybe, known_sets, num, den), "led_links")
    stage.drop("led_sets")
    first = stage.put(components(links, stage, "first"), "first")

    def compared(known: DataFrame, one: bool, name: str) -> DataFrame:
        """The links among pairs of the lists in which two of the known components still meet."""
        rows = shared.drop("lead", "last").join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        mixed = rows.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).filter(F.col("x") < F.col("y"))
        open_rows = rows.join(mixed.select("tok", F.ceil(F.col("m") / CHUNK).alias("part")), "tok").join(sketches.drop("n"), "rep")
        pairs = stage.put(list_pairs(open_rows, num, den, one), f"{name}_pairs")
        rest_sets = stage.put(full_sets(docs, _ends(pairs), k, doc_id, text), f"{name}_sets")
        found = stage.put(verified(pairs, rest_sets, num, den), f"{name}_links")
        stage.drop(f"{name}_sets", f"{name}_pairs")
        return found

    links = links.unionByName(compared(first, True, "likely"))
    second = stage.put(components(links, stage, "second"), "second")
    more = compared(second, False, "rest")
    stage.drop("shared")

    # a link between two components joins what is joined already
    whole = stage.put(components(links.unionByName(more), stage, "whole"), "whole")
    named = reps.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h", "g", F.coalesce("comp", "rep").alias("component_id"))
    out = keys.join(named, ["n", "h", "g"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
