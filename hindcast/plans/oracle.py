"""DuckDB SQL by query name."""

from hindcast.plans.registry import MODULES

ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
