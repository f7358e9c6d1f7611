"""Registered queries against their SQL on made tables with rows that the test data has none or few of."""

import duckdb
import pytest

from provena import catalog
from provena.operators import resolve, spans
from tests.test_queries import rows


def agree(spark, folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = catalog.queries()[name](spark, str(folder))
    found = con.execute(catalog.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


def table(folder, name, sql):
    duckdb.connect().execute(f"copy ({sql}) to '{folder / name}.parquet' (format parquet)")


@pytest.fixture
def events(tmp_path):
    """Pairs of events that touch or miss each other by the part of a second that is rounded, halves among them."""
    at = {0: 0.4, 1: 99.6, 7: 1_000_000.4, 8: 1_003_599.6, 10: 2_000_000.4, 11: 2_035_999.6, 20: 3_000_000.5, 21: 3_036_000.5, 30: 4_000_001.5, 31: 4_036_000.5, 40: 5_000_000.4, 41: 5_000_099.5}
    values = ", ".join(f"({k}, make_timestamp((1704067200 * 1000000::bigint) + ({s} * 1000000)::bigint), {k // 10}, '{'click' if k % 2 else 'error'}')" for k, s in at.items())
    table(tmp_path, "events", f"select event_id::bigint as event_id, ts, user_id::bigint as user_id, event_type, 1.0::double as value, '' as props from (values {values}, (90, timestamp '2024-03-01 00:00:00.4', 9, 'click'), (91, timestamp '2024-03-01 09:59:59.6', 9, 'error')) v(event_id, ts, user_id, event_type)")
    return tmp_path


@pytest.mark.parametrize("name", ["range_tagging", "innermost_region"])
def test_regions_of_parts_of_seconds(spark, events, name):
    agree(spark, events, name)


def test_facts_outside_regions_of_parts_of_seconds(spark, events):
    agree(spark, events, "inert_facts")


def test_overlaps_of_parts_of_seconds(spark, events):
    agree(spark, events, "long_spans")


def test_of_equal_spans_the_same_one_is_misplaced(spark):
    found = [spans.misplaced(spark.createDataFrame([("s", 0, 5, k) for k in order], "source string, start long, end long, id long")).collect() for order in ((1, 2), (2, 1))]
    assert [[r.id for r in f] for f in found] == [[2], [2]]


def test_imports_are_reduced_before_uses_meet_them(spark):
    """Many uses of a name that many directives bring in: a join of the two would have a row for each pair."""
    uses = spark.range(500).selectExpr("id as use", "'p' as package", "case when id < 499 then 'f' else 'g' end as name")
    imported = spark.range(500).selectExpr("'p' as package", "cast(id as int) as pos", "0 as name_pos", "'f' as local", "concat('q', id) as from_pkg", "'f' as remote", "true as known")
    found = resolve.import_lookup(uses, imported)
    assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["from_pkg"], r["state"], r["count"]) for r in found.groupBy("from_pkg", "state").count().collect()} == {("q499", "imported", 499), (None, "absent", 1)}
