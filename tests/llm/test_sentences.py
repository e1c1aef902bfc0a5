from plumbline.llm import sentences as S

CORPUS = [
    "Set e.g. foo_bar here. Rows approx. 7 days old are archived by Dr. Miller each week. The field was added in ver. 2.1.3.", "The value is checked. Is it set? Rows approx. 9 days old are kept.", "It opens at 9 a.m. The value is checked.", "foo_bar must be set. Never drop it! baz_qux must be set.",
    "Wait... then load it. Loading takes a while... The value is checked.", "Gültig ab dem 3. Mai für alle. Siehe Nr. 5 der Liste. Der Wert gilt.", "Use names, codes, etc. The value is checked. Set e.g. baz_qux here.", "The field was added by Dr. Smith in ver. 4.2. Is it set?", "Siehe Nr. 7 der Liste. Gültig ab dem 4. Mai für alle.", "Use names, codes, etc.",
] * 30


def model(spark, extra=()):
    df = spark.createDataFrame([("s", str(i), t) for i, t in enumerate([*CORPUS, *extra])], "src string, row_key string, text string")
    got = S.split_sentences(df)
    texts = [*CORPUS, *extra]
    out = {}
    for r in got.collect():
        out.setdefault(texts[int(r.row_key)], set()).add((r.start_pos, r.end_pos))
    return {t: [t[a:b] for a, b in sorted(v)] for t, v in out.items()}


CASES = {
    "Set e.g. foo_bar here. Never drop it!": ["Set e.g. foo_bar here.", "Never drop it!"],
    "Archived by Dr. Jones. The value is checked.": ["Archived by Dr. Jones.", "The value is checked."],
    "It opens at 9 a.m. foo_bar must be set.": ["It opens at 9 a.m.", "foo_bar must be set."],
    "The default is \"Not set.\" unless foo_bar is given. The note reads \"Done.\" The value is checked.": ["The default is \"Not set.\" unless foo_bar is given.", "The note reads \"Done.\"", "The value is checked."],
    "The ticket says 'Keep this. Do not move it.' and no more. Is it set?": ["The ticket says 'Keep this. Do not move it.' and no more.", "Is it set?"],
    "(Only it may write.) The value is checked.": ["(Only it may write.)", "The value is checked."],
    "Entries (cf. the list. It is long.) are kept. Is it set?": ["Entries (cf. the list. It is long.) are kept.", "Is it set?"],
    "Notes\n\n  The value\nis checked.  \n": ["Notes", "The value\nis checked."],
    "默认值为4.61，版本为v7.1。（仅限管理员。）系统提示“完成。请稍候。”后锁定。可以吗？": ["默认值为4.61，版本为v7.1。", "（仅限管理员。）", "系统提示“完成。请稍候。”后锁定。", "可以吗？"],
    "値は毎晩更新される。画面に「完了。」と表示されます！": ["値は毎晩更新される。", "画面に「完了。」と表示されます！"],
    "ช่องนี้ห้ามว่าง ค่านี้ต้องไม่ซ้ำกัน": ["ช่องนี้ห้ามว่าง", "ค่านี้ต้องไม่ซ้ำกัน"],
    "यह अनिवार्य है। क्या foo_bar खाली है?": ["यह अनिवार्य है।", "क्या foo_bar खाली है?"],
    "Μπορεί να είναι κενό; Το πεδίο είναι υποχρεωτικό.": ["Μπορεί να είναι κενό;", "Το πεδίο είναι υποχρεωτικό."],
    "هل هو فارغ؟ هذا إلزامي. لا تحذف!": ["هل هو فارغ؟", "هذا إلزامي.", "لا تحذف!"],
    "¡No borre esto! ¿Puede quedar vacío? Ne jamais vider !": ["¡No borre esto!", "¿Puede quedar vacío?", "Ne jamais vider !"],
    "See https://x.example/a.html?v=1.5 for it. Wait... then load it. Why both?! The value is checked": ["See https://x.example/a.html?v=1.5 for it.", "Wait... then load it.", "Why both?!", "The value is checked"],
    "Gültig ab dem 7. Mai für alle. Der Wert gilt.": ["Gültig ab dem 7. Mai für alle.", "Der Wert gilt."],
    "The value is checked.The value is checked": ["The value is checked.", "The value is checked"],
    "...": ["..."], "\"unclosed. The value is checked.": ["\"unclosed.", "The value is checked."],
}


def test_cases(spark):
    got = model(spark, [*CASES, " ", "", None, "x " * 20000 + "end. The value is checked."])
    for t, want in CASES.items():
        assert got.get(t) == want, t
    assert " " not in got and "" not in got and None not in got
    assert len(got["x " * 20000 + "end. The value is checked."]) == 2


def test_empty_and_repeats(spark):
    schema = "src string, row_key string, text string, what int"
    assert S.split_sentences(spark.createDataFrame([], schema)).count() == 0
    rows = [("s", "1", "One here. Two here.", 1), ("s", "1", "One here. Two here.", 2)]
    assert S.split_sentences(spark.createDataFrame(rows, schema)).count() == 2


def test_likelihood_ratio():
    assert S.llr(10, 100, 10, 100) == 0 and S.llr(90, 100, 10, 100) > 100 and S.llr(10, 100, 90, 100) < -100 and S.llr(0, 0, 1, 2) == 0


def test_long_and_unbalanced_texts_take_linear_time():
    import time

    model = S.Model(set(), {("LATIN", "it")})
    began = time.time()
    assert len(S.units("It is so. " * 60000, model)) == 60000
    assert len(S.units("(" * 100000 + " It is so. It is so.", model)) == 2
    assert len(S.units("\"" + "It is so. " * 30000 + "\"", model)) == 1
    assert len(S.units("a" * 200000 + ". It", model)) == 2
    assert time.time() - began < 30
