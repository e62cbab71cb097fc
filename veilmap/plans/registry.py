"""Query registry: each query has a Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
SQL_VIEWS: dict[str, str] = {}


def sql_view(name: str, body: str) -> None:
    """A named building block of the oracles. Later views may use earlier ones."""
    SQL_VIEWS[name] = body


def compose(select: str) -> str:
    """Put the views a statement mentions, and the views those mention, before it."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(SQL_VIEWS[name])

    visit(select)
    ctes = [f"{n} AS MATERIALIZED ({SQL_VIEWS[n].strip()})" for n in SQL_VIEWS if n in wanted]
    if not ctes:
        return select.strip()
    body = select.strip()
    if body.lower().startswith("with "):
        body = body[5:]
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None):
    def register(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = compose(sql)
        return plan

    return register
