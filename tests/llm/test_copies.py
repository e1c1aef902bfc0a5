from plumbline.llm.copies import collapse, copy_groups, copy_pairs

SCHEMA = "record_id long, sentence string, column_name string, names string, f1 string, keep_id string, f2 long"


def groups(spark, rows):
    df = spark.createDataFrame([(i, s, c, "x", "y", "z", 1) for i, s, c in rows], SCHEMA)
    return df, copy_groups(df, "record_id", "sentence", "column_name")


def pairs(spark, rows):
    return {tuple(r) for r in copy_pairs(groups(spark, rows)[1]).collect()}


def test_formatting_is_no_difference(spark):
    rows = [
        (1, "The a_b column must be > 5, always.", "a, b"), (2, "“the  A_B column must be >5 always”", '"B";`a`'), (3, "THE A_B COLUMN MUST BE > 5 ALWAYS…", "[b,a,a]"), (4, "the a_b ​column — must be > 5 always", " a ,b "),
        (5, "The a_b column must be < 5, always.", "a, b"), (6, "The a_b column must be > -5, always.", "a, b"), (7, "The a_b column must be > 0.5, always.", "a, b"), (8, "The a_b column must be > 05 always", "a, b"), (9, "The a_b column must be > 5, always.", "a"),
        (10, "column the a_b must be > 5 always", "a, b"), (11, "The a_b column must be > −5 always", "b a"), (12, "The ab column must be > 5, always.", "a, b"),
    ]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (1, 4), (6, 11)}


def test_nulls_blanks_and_repeats(spark):
    rows = [(1, None, "a"), (2, None, "a"), (3, " \n", "a"), (4, "​", "a"), (5, "x y", None), (6, "x, y", " "), (6, "x, y", " "), (None, "x y", None), (7, "x-y", ""), (8, "x y", "a")]
    assert pairs(spark, rows) == {(5, 6), (5, 7)}
    assert pairs(spark, []) == set()


def test_a_third_of_all_rows_is_one_group(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i}", "c") for i in range(600)]
    df, g = groups(spark, rows)
    assert copy_pairs(g).count() == 199
    kept = {r.record_id: r.n_copies for r in collapse(df, g, "record_id").collect()}
    assert len(kept) == 401 and kept[0] == 200 and kept[1] == 1


def test_long_texts(spark):
    rows = [(1, "1.1" * 60000, "a"), (2, "1.1" * 60000 + "!", "a"), (3, "word " * 100000, "x," * 50000), (4, "Word, " * 100000, "x"), (5, "." * 100000, None), (6, "…", "")]
    assert pairs(spark, rows) == {(1, 2), (3, 4), (5, 6)}


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    from plumbline.llm import copies

    rows = [(i, "same  text" if i % 3 == 0 else f"text {i % 40}", "c") for i in range(300)]
    want = pairs(spark, rows)
    monkeypatch.setattr(copies, "HOT_ROWS", 50)
    assert pairs(spark, rows) == want and len(want) > 200


def test_many_names_in_one_record(spark):
    many = ",".join(f"c{i}" for i in range(300_000))
    assert pairs(spark, [(1, "x y", many), (2, "X, y", many.upper())]) == {(1, 2)}
