"""Queries by name."""

from hindcast.plans import context_plans, decision_plans, lifecycle_plans, news_plans, normalization, raw_plans, reasoning_plans, regime_plans, stat_plans, stream_plans, study

MODULES = (study, normalization, raw_plans, decision_plans, lifecycle_plans, context_plans, news_plans, regime_plans, stat_plans, reasoning_plans, stream_plans)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
