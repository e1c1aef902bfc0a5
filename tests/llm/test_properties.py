"""Properties that hold for any input; no session is needed."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import encoding, overlap, packing, sampling
from plumbline.llm import sentences as S

regex = pytest.importorskip("regex")
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
BLANKS = set(map(chr, encoding._BLANKS))


def _same_blanks(t: str) -> bool:
    """The two engines agree on what a blank and an assigned letter is in t."""
    return all((c in BLANKS) == bool(regex.match(r"\s", c)) for c in t) and not any(encoding.unicodedata.category(c) == "Cn" or 0xD800 <= ord(c) < 0xE000 for c in t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sretlmvdab1½!é "), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_boundaries_are_those_of_the_pattern(texts):
    import numpy as np

    texts = [t for t in texts if _same_blanks(t)]
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    at, want = 0, []
    for t in texts:
        if t:
            first[at] = True
        want += [at + m.start() for m in PATTERN.finditer(t)]
        at += len(t)
    assert np.flatnonzero(encoding.boundaries(points, first)).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(1, 60))
def test_packs(lengths, capacity):
    lengths = [x for x in lengths if x <= capacity]
    packs = packing.best_two_fit(lengths, capacity)
    assert sorted(x for p in packs for x in p) == sorted(x for x in lengths if x) and all(0 < sum(p) <= capacity for p in packs)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab_. !?\n\"'()«»“”。！ทก1DrT…"), max_size=60))
def test_units_are_ordered_and_cover_the_text(t):
    model = S.Model({("LATIN", "dr")}, {("LATIN", "t"), ("LATIN", "#id")})
    got, last = S.units(t, model), 0
    for a, b in got:
        assert last <= a < b <= len(t) and not t[a].isspace() and not t[b - 1].isspace() and not t[last:a].strip(S._OUTER)
        last = b
    assert not t[last:].strip(S._OUTER)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from(["unique", "composite_unique", "not_null", "expression", "no_claim", "dbt"]), st.tuples(st.integers(0, 100), st.integers(0, 40), st.integers(0, 90)), min_size=1))
def test_allocation_keeps_within_what_is_there(spec):
    asked = [{"category": c, "target_share": s / 100, "min_rows": m, "sample_rows": 50} for c, (s, m, _) in spec.items()]
    got = sampling.allocate(asked, {c: h for c, (_, _, h) in spec.items()})
    have, floors = sum(r["at_hand"] for r in got), sum(min(m, h) for _, m, h in spec.values())
    goal = max(50 if any(s for s, _, _ in spec.values()) else 0, floors)
    assert all(min(spec[r["category"]][1], r["at_hand"]) <= r["drawn"] <= r["at_hand"] for r in got)
    assert sum(r["quota"] for r in got) == goal and sum(r["drawn"] for r in got) == min(goal, have) and sum(r["unmet"] for r in got) == max(0, goal - have)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=8), st.lists(st.integers(0, 3), max_size=8))
def test_distance_is_symmetric(a, b):
    assert overlap.within(a, b, 2) == overlap.within(b, a, 2)
