"""Sentences of evaluation splits that also stand, the same or nearly so, in the training split.

Two sentences overlap if their word lists differ by at most two words inserted, dropped or replaced.

1. Equal texts of one side are one text: a partially aggregated grouping, so a text that a third of all records share is one row.
2. The evaluation texts are indexed in shards, each a compressed full-text index (``FMIndex``) that is built once and written to the
   shared folder. A shard is cut into parts of at most about ``PART_WORDS`` words.
3. A training text is cut into three runs of words. Two edits leave one of the three untouched, so it stands in the evaluation text as it
   is. The cuts are laid so that each run holds a third of the text's rare words. A run is sent to one shard, that of its anchor, the rare
   word with the least hash; a text is indexed in the shards of all its rare words (of all its words, if few are rare), so the shard of
   an untouched run always has it.
4. The runs stream past the parts of their shard in salted blocks of about ``BLOCK_RUNS``, so no task holds more than one part and one
   block whatever the size of the training split or of a shard. Each run is matched by backward search, and all its occurrences at places
   that two edits can explain are located.
5. For each pair of texts the located runs are extended on both sides to maximal matches, the matches are merged into spans, and the
   spans are counted; an exact comparison of the word lists decides. Pairs are expanded to records at the very end.
6. Texts of at most two words on both sides are within two edits of each other by definition, and need not share a word. They are paired
   without an index, in blocks; the result is as large as that anyway.

Which words count as frequent (in more than one of ``RARE`` texts, counted over all texts) only decides where a text is indexed, never
whether a pair is found.

Defined cases: null and blank sentences, null ids and splits other than train, validation and test take no part; a sentence without any
word has the empty list; splits are read without outer blanks and case; repeated rows count once; empty tables give no pairs; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.fmindex import FMIndex
from plumbline.llm.words import is_blank, words
from plumbline.session import cut, table

EDITS = 2
#: A word in more than one of so many texts is frequent; there are at most RARE times the mean text length of them.
RARE = 2000
#: Evaluation texts per shard, before a text is indexed under several words.
SHARD_TEXTS = 5000
#: Words of an index part, and training runs in a block that is held against it.
PART_WORDS, BLOCK_RUNS = 2_000_000, 500_000
#: Texts of at most EDITS words in a block of those that are paired without an index.
SHORT_BLOCK = 2000
#: Rows up to which a list of pairs or texts is sent to all executors instead of shuffling the texts.
SMALL_ROWS = 100_000
#: The same for the characters of such a list's texts.
SMALL_CHARS = 30_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 32-bit codes."""
    z = x.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return z >> np.uint64(25)


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], pa.list_(pa.int32()))
    offsets = np.asarray(a.offsets, dtype=np.int64)
    return np.asarray(a.values)[offsets[0] : offsets[-1]] if len(offsets) > 1 else np.zeros(0, np.int32), offsets - offsets[0]


def _frequent_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words that are frequent within this partition; a word that is frequent overall is so in some partition."""
    total, rows, pending = {}, 0, []

    def fold() -> None:
        values, counts = np.unique(np.concatenate(pending), return_counts=True)
        for v, c in zip(values[counts > 1].tolist(), counts[counts > 1].tolist()):
            total[v] = total.get(v, 0) + c
        pending.clear()

    for b in batches:
        flat, _ = _lists(b.column(0))
        rows += b.num_rows
        pending.append(flat)
        if sum(map(len, pending)) > 2_000_000:
            fold()
    if pending:
        fold()
    floor = max(2, rows // RARE)
    kept = {k: v for k, v in total.items() if v >= floor}
    yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array(list(kept.values()), pa.int64())], ["code", "n"])


def frequent_words(texts: DataFrame, n_texts: int) -> np.ndarray:
    """Codes of frequent words, sorted; at most RARE times the mean number of words in a text."""
    seen = texts.select("codes").mapInArrow(_frequent_here, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = seen.where(F.col("n") > max(2, n_texts // RARE)).select("code").toPandas()
    return np.sort(rows["code"].to_numpy(dtype=np.int32))


def _rare(flat: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.ones(len(flat), bool)
    i = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
    return frequent[i] != flat


def _runs(flat: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Three runs of every text: text number, first and last position in ``flat``, anchor code."""
    n = np.diff(offsets)
    rare = _rare(flat, frequent)
    upto = np.concatenate(([0], np.cumsum(rare)))
    r0, r = upto[offsets[:-1]], upto[offsets[1:]] - upto[offsets[:-1]]
    rare_at = np.flatnonzero(rare)
    edges = [offsets[:-1]]
    for j in (1, 2):
        by_rare = rare_at[np.minimum(r0 + j * r // 3, max(0, len(rare_at) - 1))] if len(rare_at) else offsets[:-1]
        edges.append(np.where(r >= 3, by_rare, offsets[:-1] + j * n // 3))
    edges.append(offsets[1:])
    number = np.concatenate([np.arange(len(n))] * 3)
    first, last = np.concatenate(edges[:3]), np.concatenate(edges[1:])
    keep = last > first
    number, first, last = number[keep], first[keep], last[keep]
    order = np.argsort(first, kind="stable")
    number, first, last = number[order], first[order], last[order]
    if not len(first):
        return number, first, last, np.zeros(0, np.int32)
    weight = _mix(flat) + np.where(rare, np.uint64(0), np.uint64(1 << 62))
    least = np.minimum.reduceat(weight, first)  # the runs of all texts lie one after the other
    per_word = np.repeat(least, last - first)
    hit = np.flatnonzero(weight == per_word)
    run_of = np.repeat(np.arange(len(first)), last - first)[hit]
    anchor = np.zeros(len(first), np.int32)
    anchor[run_of[::-1]] = flat[hit[::-1]]
    return number, first, last, anchor


def _route_runs(frequent: np.ndarray, shards: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = _lists(b.column(1))
            ids = np.asarray(b.column(0))
            number, first, last, anchor = _runs(flat, offsets, frequent)
            words_ = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(last - first))), pa.int32()), pa.array(flat[: int(last.max()) if len(last) else 0], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((_mix(anchor) % np.uint64(shards)).astype(np.int32)), pa.array(ids[number]), pa.array((first - offsets[number]).astype(np.int32)),
                    pa.array(np.diff(offsets)[number].astype(np.int32)), words_,
                ], ["shard", "t_id", "at", "n", "codes"],
            )

    return route


def _route_texts(frequent: np.ndarray, shards: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = _lists(b.column(1))
            number = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            rare = _rare(flat, frequent)
            few = np.bincount(number[rare], minlength=b.num_rows) < 3 + EDITS
            keep = rare | few[number]
            pairs = np.unique(number[keep] * shards + (_mix(flat[keep]) % np.uint64(shards)).astype(np.int64))
            row = pa.array(pairs // shards)
            yield pa.RecordBatch.from_arrays([pa.array((pairs % shards).astype(np.int32)), b.column(0).take(row), b.column(1).take(row)], ["shard", "e_id", "codes"])

    return route


_INDEX = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("blob", pa.binary())])
_HITS = pa.schema([("t_id", pa.int64()), ("e_id", pa.int64()), ("t_at", pa.int32()), ("e_at", pa.int32()), ("n", pa.int32())])


def _build_part(key: tuple, texts: pa.Table) -> pa.Table:
    """The index of one part of a shard, as one row."""
    flat, offsets = _lists(texts.column("codes"))
    row = [[key[0].as_py()], [key[1].as_py()], [np.asarray(texts.column("e_id"))], [np.diff(offsets).astype(np.int32)], [FMIndex.build(flat, offsets).dump()]]
    return pa.table([pa.array(c, t.type) for c, t in zip(row, _INDEX)], schema=_INDEX)


def _match_block(runs: pa.Table, part: pa.Table) -> pa.Table:
    """A block of training runs against one part: the occurrences that at most EDITS edits can explain."""
    if not runs.num_rows or not part.num_rows:
        return _HITS.empty_table()
    index = FMIndex.load(part.column("blob")[0].as_py())
    e_id, e_n = np.asarray(part.column("ids")[0].values), np.asarray(part.column("sizes")[0].values).astype(np.int64)
    words_, cuts = _lists(runs.column("codes"))
    lo, hi = index.search(index.encode(words_), cuts[:-1], cuts[1:])
    t_id, t_at, t_n = (np.asarray(runs.column(c)).astype(np.int64) for c in ("t_id", "at", "n"))
    length, out = np.diff(cuts), []
    found = np.flatnonzero(hi > lo)
    done, ends = 0, np.cumsum(hi[found] - lo[found])
    while done < len(found):  # so many occurrences at a time that memory is bounded
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 1_000_000)))
        some = found[done:stop]
        k = hi[some] - lo[some]
        run = np.repeat(some, k)
        text, at = index.locate(np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[some], k))
        near = (np.abs(at - t_at[run]) <= EDITS) & (np.abs(e_n[text] - t_n[run]) <= EDITS)
        near &= np.abs((e_n[text] - at) - (t_n[run] - t_at[run])) <= EDITS
        run, text, at = run[near], text[near], at[near]
        out.append(pa.table([pa.array(x).cast(f.type) for x, f in zip((t_id[run], e_id[text], t_at[run], at, length[run]), _HITS)], schema=_HITS))
        done = stop
    return pa.concat_tables(out) if out else _HITS.empty_table()


def occurrences(coded: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """coded(side, id, codes) -> (t_id, e_id, hits): where runs of training texts stand in evaluation texts."""
    frequent = frequent_words(coded, sum(sizes.values()))
    shards = max(8, -(-sizes.get(1, 0) // SHARD_TEXTS))
    texts = coded.where("side = 1").select("id", "codes").mapInArrow(_route_texts(frequent, shards), "shard int, e_id long, codes array<int>")
    parts = texts.groupBy("shard").agg(F.ceil(F.sum(F.size("codes") + 1) / PART_WORDS).cast("int").alias("parts"))
    placed = texts.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("e_id"), F.col("parts")).cast("int"))
    index = cut(placed.groupBy("shard", "part").applyInArrow(_build_part, "shard int, part int, ids array<long>, sizes array<int>, blob binary"))
    runs = cut(coded.where("side = 0").select("id", "codes").mapInArrow(_route_runs(frequent, shards), "shard int, t_id long, at int, n int, codes array<int>"))
    # a row per shard: its parts and the number of blocks that its runs are dealt to
    plan = index.groupBy("shard").agg(F.collect_set("part").alias("parts")).join(runs.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_RUNS).cast("int").alias("blocks")), "shard")
    plan = cut(plan)
    left = runs.join(plan, "shard").select("shard", F.explode("parts").alias("part"), F.pmod(F.xxhash64("t_id"), F.col("blocks")).cast("int").alias("block"), "t_id", "at", "n", "codes")
    right = index.join(plan.drop("parts"), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["shard", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_match_block, "t_id long, e_id long, t_at int, e_at int, n int")
    return cut(found.groupBy("t_id", "e_id").agg(F.collect_set(F.struct("t_at", "e_at", "n")).alias("hits")))  # at most three runs at five places each


def maximal_spans(t: list, e: list, hits: list) -> list[tuple[int, int]]:
    """Maximal matches through the hits (t_at, e_at, n), merged into spans of ``t`` (start, end) that neither touch nor overlap."""
    matches = set()
    for i, j, n in hits:
        a = 0
        while i - a > 0 and j - a > 0 and t[i - a - 1] == e[j - a - 1]:
            a += 1
        b = n
        while i + b < len(t) and j + b < len(e) and t[i + b] == e[j + b]:
            b += 1
        if t[i : i + n] == e[j : j + n]:  # codes may be shared by two words
            matches.add((i - a, i + b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(matches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def within(a: list, b: list, limit: int) -> int:
    """Edit distance of two lists if it is at most ``limit``, else ``limit`` + 1. Only what lies between common ends is compared."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(a) - i and j < len(b) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    big = limit + 1
    row = {d: d for d in range(limit + 1)}  # column -> distance, within the band
    for x in range(1, len(a) + 1):
        new = {}
        for y in range(max(0, x - limit), min(len(b), x + limit) + 1):
            best = row.get(y, big) + 1
            if y:
                best = min(best, new.get(y - 1, big) + 1, row.get(y - 1, big) + (a[x - 1] != b[y - 1]))
            new[y] = min(best, big)
        row = new
        if min(row.values(), default=big) >= big:
            return big
    return min(row.get(len(b), big), big)


_PAIR = "t_id long, t_copies long, e_id long, e_copies long, distance int, n_spans int, n_matched int, longest int"


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for s, x, hits in zip(b["t_text"], b["e_text"], b["hits"]):
            t, e = (y.split(" ") if y else [] for y in (s, x))
            spans = maximal_spans(t, e, [(h["t_at"], h["e_at"], h["n"]) for h in hits])
            rows.append((within(t, e, EDITS), len(spans), sum(z - a for a, z in spans), max((z - a for a, z in spans), default=0)))
        got = pd.DataFrame(rows, columns=["distance", "n_spans", "n_matched", "longest"], index=b.index)
        yield pd.concat([b[["t_id", "t_copies", "e_id", "e_copies"]], got], axis=1)


def _short_pairs(texts: DataFrame) -> DataFrame:
    """Texts of at most EDITS words on both sides; every pair of them is a case, so the blocks only spread the work."""
    short = texts.where(F.col("n") <= EDITS)
    t = short.where("side = 0").select(F.col("id").alias("t_id"), F.col("text").alias("t_text"), F.col("copies").alias("t_copies"))
    e = short.where("side = 1").select(F.col("id").alias("e_id"), F.col("text").alias("e_text"), F.col("copies").alias("e_copies"))
    counts = short.groupBy("side").agg(F.count("*").alias("n")).collect()
    blocks = max([1, *(-(-r["n"] // SHORT_BLOCK) for r in counts if r["side"] == 1)])
    t = t.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    e = e.withColumn("_b", F.pmod(F.xxhash64("e_id"), F.lit(blocks)).cast("int"))
    return t.join(e, "_b").withColumn("hits", F.array().cast("array<struct<t_at:int,e_at:int,n:int>>"))


def cross_split_overlaps(records: DataFrame, rid: str, sentence: str, split: str) -> DataFrame:
    """records -> (train_id, eval_id, distance, n_spans, n_matched, longest): all overlapping pairs of a training and an evaluation record.

    ``n_spans`` counts the merged maximal matches, ``n_matched`` the words of the training text in them, ``longest`` those of the longest.
    """
    spark = records.sparkSession
    name = F.lower(F.regexp_replace(F.col(split), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    side = F.when(name == "train", F.lit(0)).when(name.isin("validation", "test"), F.lit(1))
    norm = records.select(F.col(rid).cast("long").alias("record_id"), side.alias("side"), F.col(sentence).alias("_s"))
    norm = norm.where(F.col("record_id").isNotNull() & F.col("side").isNotNull() & ~is_blank(F.col("_s")))
    norm = cut(norm.select("record_id", "side", F.array_join(words(F.col("_s")), " ").alias("text")))
    texts = norm.groupBy("side", "text").agg(F.min("record_id").alias("id"), F.count("*").alias("copies"))
    texts = cut(texts.withColumn("n", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))))
    coded = texts.where("n > 0").select("side", "id", F.transform(F.split("text", " "), lambda w: F.hash(w)).alias("codes"))
    sizes = {r["side"]: r["n"] for r in texts.groupBy("side").agg(F.count("*").alias("n")).collect()}
    found = occurrences(coded, sizes)
    few = _small(found, found.count())
    t = texts.where("side = 0").select(F.col("id").alias("t_id"), F.col("text").alias("t_text"), F.col("copies").alias("t_copies"), F.col("n").alias("t_n"))
    e = texts.where("side = 1").select(F.col("id").alias("e_id"), F.col("text").alias("e_text"), F.col("copies").alias("e_copies"), F.col("n").alias("e_n"))
    # each join brings in one side's texts for the pairs; the pairs go to the texts where they are few
    if few is not found:
        with_t = cut(t.join(few, "t_id"))
        size = with_t.agg(F.sum(F.length("t_text"))).first()[0] or 0
        both = e.join(F.broadcast(with_t) if size <= SMALL_CHARS else with_t, "e_id")
    else:
        both = found.join(t, "t_id").join(e, "e_id")
    columns = ("t_id", "t_text", "t_copies", "e_id", "e_text", "e_copies", "hits")
    both = both.where((F.col("t_n") > EDITS) | (F.col("e_n") > EDITS)).select(*columns).unionByName(_short_pairs(texts).select(*columns))
    pairs = cut(both.mapInPandas(_verify, _PAIR).where(F.col("distance") <= EDITS))
    return _expand(spark, pairs, texts, norm)


_FACTS = ("distance", "n_spans", "n_matched", "longest")


def _expand(spark: SparkSession, pairs: DataFrame, texts: DataFrame, norm: DataFrame) -> DataFrame:
    """From texts to the records that have them."""
    many = pairs.where("t_copies > 1").select(F.col("t_id").alias("id"), F.lit(0).alias("side")).union(pairs.where("e_copies > 1").select(F.col("e_id"), F.lit(1))).distinct()
    many = cut(many)
    rows = many.count()
    if not rows:
        return pairs.select(F.col("t_id").alias("train_id"), F.col("e_id").alias("eval_id"), *_FACTS)
    wanted = cut(texts.join(_small(many, rows), ["id", "side"], "left_semi").select("side", "text", "id"))
    members = cut(norm.join(_small(wanted, rows * 8), ["side", "text"]).select("side", "id", "record_id").distinct())
    t = members.where("side = 0").select(F.col("id").alias("t_id"), F.col("record_id").alias("_t"))
    e = members.where("side = 1").select(F.col("id").alias("e_id"), F.col("record_id").alias("_e"))
    out = pairs.join(t, "t_id", "left").join(e, "e_id", "left")
    return out.select(F.coalesce("_t", "t_id").alias("train_id"), F.coalesce("_e", "e_id").alias("eval_id"), *_FACTS).distinct()


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mine_claims_release").select("record_id", "sentence", "split", "source_document", "source_kind")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of overlapping records across the splits."""
    got = cross_split_overlaps(_claims(spark, d), "record_id", "sentence", "split")
    return got.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records with an overlap, per split and source document of the evaluation record."""
    claims = _claims(spark, d)
    got = cut(cross_split_overlaps(claims, "record_id", "sentence", "split"))
    best = got.groupBy("eval_id").agg(F.min("distance").alias("distance"), F.count("*").alias("n_train"), F.sum("n_spans").alias("n_spans"), F.max("longest").alias("longest"))
    meta = claims.select(F.col("record_id").alias("eval_id"), F.lower(F.trim("split")).alias("split"), "source_kind", "source_document").dropDuplicates(["eval_id"])
    return best.join(meta, "eval_id").groupBy("split", "source_kind", "source_document").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("distance") == 0).alias("n_equal"), F.count_if(F.col("distance") > 0).alias("n_near"), F.sum("n_train").alias("n_pairs"),
        F.sum("n_spans").alias("n_spans"), F.max("longest").alias("longest_span"),
    )


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

ORACLE = {}
