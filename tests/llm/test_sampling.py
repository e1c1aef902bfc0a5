from plumbline.llm import sampling


def _asked(**shares):
    return [{"category": c, "target_share": s, "min_rows": m, "sample_rows": 100} for c, (s, m) in shares.items()]


def test_unmet_quota_goes_to_siblings_then_cousins():
    asked = _asked(unique=(0.5, 0), composite_unique=(0.1, 0), not_null=(0.3, 0), no_claim=(0.1, 0))
    got = {r["category"]: r for r in sampling.allocate(asked, {"unique": 20, "composite_unique": 15, "not_null": 100, "no_claim": 100})}
    assert got["unique"] == {"category": "unique", "parent": "composite_unique", "needed": 50, "quota": 50, "at_hand": 20, "drawn": 20, "lacking": 30, "unmet": 0, "over": 0}
    assert got["composite_unique"]["drawn"] == 15  # its sibling's share first
    assert sum(r["drawn"] for r in got.values()) == 100
    short = {r["category"]: r for r in sampling.allocate(asked, {"unique": 1})}
    assert sum(r["unmet"] for r in short.values()) == 99 and short["not_null"]["drawn"] == 0


def test_the_sample_has_the_size_asked():
    odd = _asked(**{c: (0.18 if c == "a" else 0.164, 5) for c in "abcdef"})
    assert sum(r["drawn"] for r in sampling.allocate(odd, dict.fromkeys("abcdef", 500))) == 100
    small = {r["category"]: r for r in sampling.allocate(_asked(a=(0.98, 0), b=(0.01, 20), c=(0.01, 0)), dict.fromkeys("abc", 500))}
    assert (small["a"]["drawn"], small["b"]["drawn"], small["c"]["drawn"]) == (79, 20, 1)
    floors = sampling.allocate(_asked(a=(0.9, 10), b=(0.1, 300)), {"a": 500, "b": 200})
    assert [(r["drawn"], r["over"]) for r in floors] == [(10, 110), (200, 110)]


def test_groups_have_quotas():
    asked = _asked(a=(0.4, 0), b=(0.2, 0), c=(0.4, 0))
    got = {r["category"]: r["drawn"] for r in sampling.allocate(asked, {"a": 10, "b": 30, "c": 500}, {"a": "x", "b": "x", "c": "y"})}
    assert got == {"a": 10, "b": 30, "c": 60}
    assert sampling.name_groups(["unique", "composite_unique", "no_claim", "fhir_r5", "key_composite"]) == {"unique": "composite_unique", "composite_unique": "composite_unique", "key_composite": "composite_unique", "no_claim": "no_claim", "fhir_r5": "fhir_r5"}


def test_quota_is_rounded_up_exactly():
    assert sampling.allocate([{"category": "a", "target_share": 0.07, "min_rows": 0, "sample_rows": 100}], {})[0]["needed"] == 7
    assert sampling.allocate([{"category": "a", "target_share": 0.071, "min_rows": 30, "sample_rows": 100}], {})[0]["needed"] == 30


def _data(spark):
    claim = "struct<type:string>"
    progress = spark.createDataFrame(
        [("m", "r", [(1, ("Unique ",)), (2, None), (None, ("unique",)), (3, (None,)), None], 1), ("m", "r", [(1, ("Unique ",)), (2, None)], 1), (None, "r", [(9, ("unique",))], 1)], f"model string, run string, records array<struct<item_index:long,claim:{claim}>>, category int"
    )
    claims = spark.createDataFrame([(i, "dbt" if i % 3 else " FHIR_r5") for i in range(900)] + [(1, "dbt"), (None, "dbt"), (950, None), (951, "other")], "record_id long, source_kind string")
    return claims, progress


def test_rows_at_hand_and_draw(spark):
    claims, progress = _data(spark)
    leaves = sampling.category_rows(claims, progress)
    rows = [("k", "mine_claims_release.source_kind", "dbt", 0.5, 1, 100), ("k", "mine_claims_release.source_kind", "fhir_r5", 0.5, 400, 100), ("k", "mine_claims_release.source_kind", "smithy", 0.01, 0, 100), ("t", "progress.records.claim.type", "unique", 0.5, 0, 2), ("t", "progress.records.claim.type", "no_claim", 0.5, 2, 2)]
    target = spark.createDataFrame(rows, "mix_name string, field_name string, category string, target_share double, min_rows long, sample_rows long")
    plan = {(r.mix_name, r.category): r for r in sampling.plan_mixes(spark, leaves, target).collect()}
    assert plan["k", "fhir_r5"].at_hand == 300 and plan["k", "fhir_r5"].needed == 400 and plan["k", "smithy"].at_hand == 0
    assert plan["t", "unique"].at_hand == 1 and plan["t", "no_claim"].at_hand == 1 and plan["t", "no_claim"].needed == 2
    drawn = sampling.draw(leaves, sampling.plan_mixes(spark, leaves, target)).collect()
    for (mix, cat), r in plan.items():
        got = sorted(x.draw_rank for x in drawn if (x.mix_name, x.category) == (mix, cat))
        assert got == list(range(1, r.drawn + 1))
    assert len({(x.mix_name, x.category, x.row_id) for x in drawn}) == len(drawn)
    nothing = sampling.plan_mixes(spark, sampling.category_rows(claims.where("false"), progress.where("false")), target)
    assert nothing.where("lacking > 0").count() == 5
