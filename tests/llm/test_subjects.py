import random

import pytest

from plumbline.llm import subjects as S

WORDS = {"law": ["court", "verdict", "judge ruling", "lawsuit"], "sport": ["goalkeeper", "league match", "race lap", "coach roster"], "health": ["nurse shift", "vaccine dose", "diagnosis", "ward admission"]}
GLOSS = [("law", "courts, verdicts and every lawsuit: court, verdict"), ("sport", "goalkeeper, league match, race, coach"), ("health", "nurse, vaccine dose, diagnosis, ward"), (None, None)]
FRAMES = ["Every {} is kept once.", "The table lists the {} of a day.", "Only one {} per row is allowed.", "Changes to a {} arrive late."]
NOTICES = ["The leader board is posted weekly.", "A race to the bottom helps nobody.", "All rights reserved.", "Null means unknown."]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    docs, labels, truth = [], [], {}
    for i in range(900):
        of = r.sample(sorted(WORDS), 2 if i % 4 == 0 else 1)
        parts = [r.choice(FRAMES).format(r.choice(WORDS[s])) for s in of for _ in range(4)] + r.sample(NOTICES, 3)
        if i % 10 == 0:
            parts.append("models:\n  - name: t_x\n    columns:\n" + "".join(f"      - name: {w.replace(' ', '_')}_id\n        tests: [unique]\n" for w in WORDS[of[0]]))
        if i % 5 == 1:  # a passing mention
            parts.append("Not to be taken for a " + r.choice(WORDS[r.choice(sorted(set(WORDS) - set(of)))]) + ".")
        r.shuffle(parts)
        docs.append((i, "\n".join(parts), "clash"))
        truth[i] = set(of)
        if i % 6 == 0:
            labels += [(i, s) for s in of] + [(i, of[0])]
    labels[0] = (labels[0][0], "health")  # a wrong one
    return docs, labels, truth


def _run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    got = S.assign_subjects(d, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame(GLOSS, "subject string, gloss string"))
    out = {}
    for r in got.collect():
        out.setdefault(r.doc_id, set()).add(r.subject)
    return out


def test_subjects_of_held_out_documents(spark, corpus):
    docs, labels, truth = corpus
    odd = [(10_000, None, ""), (10_001, "", ""), (10_002, " \n", ""), (10_003, "Null means unknown.", ""), (None, "The court is kept.", ""), (10_004, "Every verdict is kept once. " * 5000, "")]
    got = _run(spark, [*docs, *odd], [*labels, (1, "unknown subject"), (None, "law"), (2, None)])
    seen = {d for d, _ in labels}
    rest = [i for i in truth if i not in seen]
    assert sum(got.get(i) == truth[i] for i in rest) / len(rest) > 0.97
    assert not {10_000, 10_001, 10_002, 10_003, None} & set(got) and got[10_004] == {"law"}


def test_glosses_alone(spark, corpus):
    docs, _, truth = corpus
    got = _run(spark, docs, [])
    assert sum(bool(got.get(i, set()) & truth[i]) for i in truth) / len(truth) > 0.9


def test_empty(spark):
    assert _run(spark, [], []) == {} and _run(spark, [(1, "one two three", "")], []) == {}


def test_long_select_lists_are_one_listing():
    columns = ",\n ".join(f"c_{i}" for i in range(20_000))
    got = list(S.sentences(f"Before it. select {columns}\nfrom t where x\nAfter. select no end; select a from b"))
    assert [x[0] for x in got] == [False, True, False, False, True]
    assert len(list(S.sentences("select " * 200_000))) == 1  # in linear time


def test_terms_are_words_and_pairs():
    c = S.Coder()
    assert len(c.of(False, "the court a_b rules x 5 y")) == 3 + 2 and len(c.of(True, "court_rules")) == 3 and len(c.of(False, "法院判决")) == 5
    assert c.of(False, "the court")[1] == S.Coder().of(False, "a word, the court")[-2] and not len(c.of(False, ""))


def test_a_listing_is_one_sentence():
    text = 'models:\n  - name: t\n    columns:\n      - name: a_b\n        tests: [unique]\n      - name: c_d\n        tests: [x] The next sentence. ```sql\nselect a,\n b\nfrom t\n``` And {"k": ["v"]} more.'
    got = list(S.sentences(text))
    assert [x[0] for x in got].count(True) == 3 and sum("next sentence" in s for _, s in got) == 1
