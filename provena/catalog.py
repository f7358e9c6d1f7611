"""All registered queries of the dependency engine and the SQL that each must agree with."""

from __future__ import annotations

from provena.queries import code, demand, graphs, relational, tables, values


def queries() -> dict:
    return {name: query for module in (graphs, relational, code, demand, tables, values) for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in (graphs, relational, code, demand, tables, values) for name, (_, sql) in module.QUERIES.items() if sql}
