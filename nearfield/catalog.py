"""Name -> query and name -> DuckDB SQL for the analytics operators, gathered from the plans."""

from __future__ import annotations

from .plans import health_plans, neighbour_plans, objective_plans, prep_plans, summary_plans, training_plans, tree_plans

_PLANS = (neighbour_plans, prep_plans, health_plans, objective_plans, summary_plans, training_plans, tree_plans)
QUERIES: dict = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
