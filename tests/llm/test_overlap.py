import random

import numpy as np

from plumbline.llm import overlap
from plumbline.llm.fmindex import FMIndex


def test_index_finds_what_a_scan_finds():
    r = random.Random(3)
    texts = [list(t) for t in {tuple(r.randrange(6) for _ in range(r.randrange(0, 9))) for _ in range(40)}]
    flat = np.array([x for t in texts for x in t], np.int32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    index = FMIndex.load(FMIndex.build(flat, offsets).dump())
    pats = [[r.randrange(7) for _ in range(r.randrange(1, 5))] for _ in range(200)] + texts
    words = np.array([x for p in pats for x in p], np.int32)
    ends = np.cumsum([len(p) for p in pats])
    lo, hi = index.search(index.encode(words), ends - [len(p) for p in pats], ends)
    for k, p in enumerate(pats):
        want = {(i, j) for i, t in enumerate(texts) for j in range(len(t) - len(p) + 1) if t[j : j + len(p)] == p} if p else set()
        text, at = index.locate(np.arange(lo[k], max(lo[k], hi[k])))
        assert {(int(a), int(b)) for a, b in zip(text, at)} == want


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(5)
    for _ in range(3000):
        a, b = ([r.randrange(3) for _ in range(r.randrange(0, 7))] for _ in range(2))
        assert overlap.within(a, b, 2) == min(3, _distance(a, b))


def _brute(rows):
    out = set()
    for i, s, x in rows:
        for j, t, y in rows:
            if x == "train" and y in ("test", "validation"):
                a, b = s.lower().split(), t.lower().split()
                if _distance(a, b) <= 2:
                    out.add((i, j))
    return out


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_TEXTS", 20)
    monkeypatch.setattr(overlap, "RARE", 20)
    monkeypatch.setattr(overlap, "PART_WORDS", 60)  # several parts, blocks and blocks of short texts
    monkeypatch.setattr(overlap, "BLOCK_RUNS", 10)
    monkeypatch.setattr(overlap, "SHORT_BLOCK", 3)
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["the"] * 20 + ["of"] * 20
    rows = []
    for i in range(260):
        if rows and r.random() < 0.6:
            t = r.choice(rows)[1].split()
            for _ in range(r.randrange(0, 4)):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randrange(0, 2)] = [r.choice(words)] if r.random() < 0.7 else []
        else:
            t = [r.choice(words) for _ in range(r.randrange(1, 14))]
        rows.append((i, " ".join(t or ["x"]), r.choice(["train", "train", "test", "validation"])))
    rows += [(1000 + i, "copy of one and the same text", "train" if i % 2 else "test") for i in range(40)]
    df = spark.createDataFrame(rows, "record_id long, sentence string, split string")
    got = {(x.train_id, x.eval_id) for x in overlap.cross_split_overlaps(df, "record_id", "sentence", "split").collect()}
    assert got == _brute(rows)
    monkeypatch.setattr(overlap, "SMALL_ROWS", 0)  # the way without broadcasts
    assert {(x.train_id, x.eval_id) for x in overlap.cross_split_overlaps(df, "record_id", "sentence", "split").collect()} == got


def test_maximal_matches_are_merged():
    t, e = "a b c d e f g h".split(), "a b c x e f g h".split()
    assert overlap.maximal_spans(t, e, [(1, 1, 1), (0, 0, 2), (5, 5, 2)]) == [(0, 3), (4, 8)]
    assert overlap.maximal_spans(["a", "a", "a"], ["a", "a"], [(0, 0, 1), (1, 0, 1), (2, 1, 1)]) == [(0, 3)]
    assert overlap.maximal_spans(t, e, [(3, 3, 1)]) == [] and overlap.maximal_spans([], [], []) == []


def test_short_texts_need_no_common_word(spark):
    rows = [(1, "alpha beta", "train"), (2, "gamma delta", "test"), (3, "...", "train"), (4, "!!", "test"), (5, "one two three", "test"), (6, "one", "validation"), (7, "a b c d e", "train")]
    got = {(x.train_id, x.eval_id, x.distance, x.n_spans) for x in overlap.cross_split_overlaps(spark.createDataFrame(rows, "record_id long, sentence string, split string"), "record_id", "sentence", "split").collect()}
    assert got == {(1, 2, 2, 0), (1, 4, 2, 0), (1, 6, 2, 0), (3, 2, 2, 0), (3, 4, 0, 0), (3, 6, 1, 0)}


def test_dirty_rows(spark):
    rows = [(1, "Some words stand here.", " TRAIN", 1), (2, "some WORDS stand — here", "test ", 1), (3, None, "test", 1), (4, "  ", "train", 1), (5, "some words stand here", None, 1), (6, "some words stand here", "other", 1), (None, "some words stand here", "test", 1), (2, "some WORDS stand — here", "test ", 1), (7, "word " * 5000, "train", 1), (8, "word " * 4999 + "end", "Validation", 1), (9, "value > 5 is set here", "train", 1), (10, "value < -5.5 is set here", "test", 1)]
    df = spark.createDataFrame(rows, "record_id long, sentence string, split string, text int")
    got = {(x.train_id, x.eval_id, x.distance) for x in overlap.cross_split_overlaps(df, "record_id", "sentence", "split").collect()}
    assert got == {(1, 2, 0), (7, 8, 1), (9, 10, 2)}
    assert overlap.cross_split_overlaps(df.where("false"), "record_id", "sentence", "split").count() == 0
    assert overlap.cross_split_overlaps(df.where("split like '%TRAIN%'"), "record_id", "sentence", "split").count() == 0
