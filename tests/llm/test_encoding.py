import random

import pytest

from plumbline.llm import encoding as E

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "'S", " ", "  ", "\n", "\t", " ", "　", "​", "\x85", "\x1c", "a", "bc", "Z", "é", "é", "1", "٣", "½", "!", "--", "…", "👩‍🔬", "ﬁ", "一", "х", "�", "\U000e0001", "q" * 90, "?" * 130]


@pytest.fixture(scope="module")
def merger():
    try:
        return E.Merger.from_file(open(f"{E.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read())
    except OSError:
        pytest.skip("no vocabulary files")


@pytest.fixture(scope="module")
def other(merger):
    return tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=merger.ranks, special_tokens={})


def test_against_a_public_encoder(merger, other):
    r = random.Random(11)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(0, 20))) for _ in range(4000)] + ["<|endoftext|>", "don't we'll they'Re '", " 's", "x'", "\n\n 's  "]
    ids, at = E.encode_texts(texts, merger)
    vocabulary = [b for b, _ in sorted(merger.ranks.items(), key=lambda x: x[1])]
    for i, t in enumerate(texts):
        mine = ids[at[i] : at[i + 1]].tolist()
        assert mine == other.encode_ordinary(t), repr(t)
        assert E.decode(mine, vocabulary) == t and E.token_offsets(mine, vocabulary)[-1] == len(t.encode())


def test_long_runs(merger, other):
    for t in ("ab" * 20000, " " * 30000 + "x", "的" * 5000):
        assert E.encode_texts([t], merger)[0].tolist() == other.encode_ordinary(t)


def test_rows(spark, merger):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    got = sorted((str(r.doc_id), list(r.ids)) for r in E.encode(df, "doc_id", "text").collect())
    assert got == [("1", []), ("2", []), ("3", [31373, 995]), ("3", [31373, 995]), ("None", [87])]
    assert E.encode(df.where("false"), "doc_id", "text").count() == 0
    assert sorted(r.n_tokens for r in E.token_counts(df, "doc_id", "text").collect()) == [0, 0, 1, 2, 2]


def test_offsets_and_round_trip(spark):
    from plumbline.llm.encoding import decode_rows, encode_with_offsets, merger_of, vocabulary_file, vocabulary_of

    texts = [None, "", "Some words, ünï 中文 🙂\n\n x", "a" * 5000, " ​ "]
    got = encode_with_offsets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    words = vocabulary_of(merger_of(vocabulary_file(spark)))
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert [data[a : a + len(words[i])] for a, i in zip(r.starts, r.ids)] == [words[i] for i in r.ids] and len(r.starts) == len(r.ids)
    back = decode_rows(spark.createDataFrame([(r.doc_id, r.ids) for r in got] + [(9, None)], "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)} | {9: ""}
