"""What the plans of registered queries must not do, and tables that the provided ones do not reach."""

import pytest

from spanloom.operators import quality
from spanloom.plans import queries_context, queries_tables, queries_text

VALUES = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("query", [queries_text.validate_records, queries_context.stale_summaries], ids=lambda q: q.__name__)
def test_long_conversation_is_no_long_row(spark, monkeypatch, query):
    rows = [(1, t, "user", "x" * (31 if t == 7 else 10)) for t in range(300)] + [(2, 1, "user", "ab"), (2, 1, "user", "ab"), (2, 5, "user", "ab"), (5, 1, "user", "ab")]
    c = spark.createDataFrame(rows, VALUES)
    module = queries_text if query is queries_text.validate_records else queries_context
    monkeypatch.setattr(module.V, "table", lambda *a: c)
    df = query(spark, "")
    assert "collect_set" not in df._jdf.queryExecution().toString()
    got = df.collect()
    if query is queries_context.stale_summaries:
        # The first cites a block that is gone, the second one block twice.
        assert {r.conv_id: r.current for r in got} == {1: False, 2: False, 5: True}
        return
    want = lambda c, t: "malformed" if t % 11 == 0 else "no_topic" if t % 7 == 0 else "bad_confidence" if t % 4 == 0 else "unknown_citation" if t % 5 == 0 and (c != 1 or t >= 200) else "ok"
    assert sorted((r.conv_id, r.turn, r.code) for r in got) == sorted((c, t, want(c, t)) for c, t, _, _ in rows)


def test_all_apps_are_ranked(spark, monkeypatch):
    runs = spark.range(150).selectExpr("1 AS device", "concat('a', id) AS app", "0 AS start_us", "id + 1 AS end_us")
    monkeypatch.setattr(queries_context, "_runs", lambda *a: runs)
    assert queries_context.apps_sites_period(spark, "/root/testdata/sf0.001").where("kind = 'app'").count() == 150


def test_bootstrap_draws(spark, monkeypatch):
    plain, seen = quality.cluster_bootstrap, []
    monkeypatch.setattr(queries_tables.Q, "cluster_bootstrap", lambda *a, draws=2000: seen.append(draws) or plain(*a, draws=draws))
    queries_tables.cluster_bootstrap(spark, "/root/testdata/sf0.001")
    assert seen == [2000]
