"""What queries shuffle and read again: features of decisions, fits that share passes, as-of reads, raw trades."""

import numpy as np
import pandas as pd

from hindcast.operators import decisions as D
from hindcast.operators import stats as S
from hindcast.operators import raw as W
from hindcast.operators.asof import asof_join
from hindcast.operators.news import TEXTS, modelled
from hindcast.plans import decision_plans, news_plans, normalization, raw_plans, reasoning_plans

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_made_of_stored_decisions_without_a_shuffle(spark):
    rows = reasoning_plans.kept_features(spark, SF)
    assert "Exchange" not in planned(rows)
    assert rows.count() == rows.select("decision_id").distinct().count() > 5000
    assert [c for c in reasoning_plans.decisions(spark, SF).columns if not c.startswith("l_")] == []


def test_fits_that_share_passes_equal_fits_made_one_by_one(spark):
    rows = reasoning_plans.kept_features(spark, SF).where("pmod(hash(decision_id), 4) = 0")
    sets = [["mkt_spread"], ["mkt_return_short", "pos_net_proposition"], reasoning_plans.NAMES]
    together = S.logistics(rows, sets, "label", rounds=6, keep=False)
    for xs, m in zip(sets, together, strict=True):
        alone = S.logistic(rows, xs, "label", rounds=6)
        assert m["names"] == alone["names"] == xs and m["steps"] == alone["steps"] and m["scale"].keys() == alone["scale"].keys()
        assert np.allclose(m["weights"], alone["weights"], atol=1e-9)


def test_payloads_are_decoded_once(spark):
    assert "size(" not in planned(W.records(raw_plans.trade_responses(spark, SF), "executions"))


def test_trades_take_the_latest_mapping_of_their_token(spark):
    texts = [("1", "5"), ("1", "9.5"), ("1", "10"), ("2", "10"), (None, "10"), ("1", "x")]
    lists = [f'{{"conditionId":{"null" if c is None else f"""\"{c}\""""},"asset":"a","side":"buy","size":"2","price":"0.25","timestamp":"{t}","transactionHash":"h"}}' for c, t in texts]
    rows = spark.createDataFrame([(i, 0, "executions", x) for i, x in enumerate(lists)], "raw_response_id long, record_index int, surface string, record string")
    tokens = spark.createDataFrame([("1", "a", 6.0, -1, "no"), ("1", "a", 10.0, 1, "yes"), ("1", "a", 3.0, 1, "yes"), ("1", "a", 9.0, None, None)], "condition string, asset string, mapping_effective_from double, outcome_sign int, outcome_label string")
    found = [(r.positive_price, r.reason) for r in W.trades(rows, tokens, True).orderBy("raw_response_id").collect()]
    assert found == [(0.25, None), (0.75, None), (0.25, None), (None, "unmapped"), (None, "malformed"), (None, "malformed")]
    assert [r.reason for r in W.trades(rows, tokens, False).orderBy("raw_response_id").collect()] == ["malformed"] * 6


def test_an_asof_read_carries_earlier_slices_without_a_join(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 25.0), (1, 95.0), (2, 1.0), (None, 99.0)], "k int, t double")
    right = spark.createDataFrame([(1, 4.0, "a"), (1, 24.0, "b"), (2, 1.0, "c"), (None, 3.0, "d")], "k int, at double, v string")
    found = asof_join(left, right, ["k"], "t", "at", ["v"], slice_seconds=10.0)
    assert "Join" not in planned(found)
    assert {(r.k, r.t): r.v for r in found.collect()} == {(1, 5.0): "a", (1, 25.0): "b", (1, 95.0): "b", (2, 1.0): None, (None, 99.0): "d"}
    aged = asof_join(left, right, ["k"], "t", "at", ["v"], slice_seconds=10.0, max_age=50.0)
    assert {(r.k, r.t): r.v for r in aged.collect()}[(1, 95.0)] is None


def test_legs_are_not_shuffled_by_their_ids(spark):
    for name in ("reconcile_roles", "outcome_sign_asof", "audit_missing_mapping"):
        assert "hashpartitioning(leg_id" not in planned(getattr(normalization, name)(spark, SF)), name
    assert "hashpartitioning(leg_id" not in planned(news_plans.outcome_tokens_asof(spark, SF))
    assert planned(news_plans.wallet_condition_pairs(spark, SF)).count("lineitem.parquet") == 1


def test_positions_at_fixed_times_read_legs_once(spark):
    plan = planned(decision_plans.position_asof(spark, SF))
    assert plan.count("lineitem.parquet") == 1 and "Window" not in plan and "hashpartitioning(record_id" not in plan
    events = [(w, a, float(t), None if (t + a) % 5 == 0 else float(a), None if t % 3 == 0 else -1.5 * t) for w in ("v", "w") for a in (1, 2, 3) for t in range(a, 30, 2 + a)]
    rows = spark.createDataFrame([*events, events[0], ("v", None, 4.0, 1.0, 1.0), (None, 1, 4.0, 1.0, 1.0), ("v", 1, None, 9.0, 9.0), ("x", 1, 40.0, 1.0, 1.0)], "wallet string, asset int, ts double, token_change double, cash_change double")
    looks = spark.createDataFrame([(f"{w}{t}", w, t) for w in "vwx" for t in (9.0, 20.0)], "decision_id string, wallet string, t double")
    want = D.balances_asof(looks, rows.where("ts is not null"))
    columns = ["wallet", "asset", "t", "balance", "cash", "n_events", "n_unresolved"]
    found = {tuple(r) for r in D.balances_at(rows, (9.0, 20.0)).select(columns).collect()}
    assert found == {tuple(r) for r in want.select(columns).collect()} and len(found) == 14


def test_states_before_a_moment_are_read_without_pairs(spark):
    plan = planned(decision_plans.market_series_policy(spark, SF))
    assert "slot" not in plan and "Window" in plan


def test_a_model_worker_holds_the_claims_of_few_texts():
    texts = pd.DataFrame({"article": range(1000), "text": ["a. b"] * 999 + [None]})
    found = list(modelled(lambda t: [{"claim": s, "confidence": 0.5} for s in t.split(".") if s], iter([texts])))
    assert max(f["article"].nunique() for f in found) <= TEXTS
    assert pd.concat(found).values.tolist() == [[i, c, 0.5] for i in range(999) for c in ("a", "b")]
