"""Query catalogue: each entry couples a Spark plan with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelake.plans.oracle import with_views

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return plan

    return register
