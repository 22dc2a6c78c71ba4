"""User functions per group."""

import numpy as np
import pyarrow as pa

from fieldgrid.checks.q_groups import runs, slope
from fieldgrid.operators import groups


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "k string, day int, v double").repartition(parts)


def test_a_hot_group_is_worked_on_where_it_lies(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", int(i), float(2 * i + rng.normal())) for i in range(3000)] + [(f"k{i % 50}", int(i), float(-i)) for i in range(3000)]
    rows += [(None, i, 3.0) for i in range(4)] + [("one", 1, 1.0), ("gone", 1, None), ("gone", 2, None)]
    df = frame(spark, rows, 8)
    states = groups.group_states(df, ["k"], slope())
    parts = {r.k: r["count"] for r in states.groupBy("k").count().collect()}
    assert parts["hot"] == 8 and max(parts.values()) == 8 and states.count() < 500
    assert "Exchange hashpartitioning(k" not in states._jdf.queryExecution().toString()
    got = {r.k: (r.slope, r.n) for r in groups.aggregate_groups(df, ["k"], slope()).collect()}
    assert len(got) == 54 and got["one"] == (None, 1) and got["gone"] == (None, 0) and abs(got[None][0]) < 1e-9
    x, y = np.array([r[1] for r in rows if r[0] == "hot"], float), np.array([r[2] for r in rows if r[0] == "hot"])
    assert abs(got["hot"][0] - np.polyfit(x, y, 1)[0]) < 1e-9 and all(abs(got[f"k{i}"][0] + 1) < 1e-9 for i in range(50))


def test_states_are_sent_on_when_groups_are_many(spark, monkeypatch):
    monkeypatch.setattr(groups, "HELD", 3)
    df = frame(spark, [(f"k{i % 40}", i, float(i)) for i in range(800)], 2)
    assert {r.n for r in groups.aggregate_groups(df, ["k"], slope()).collect()} == {20}


def test_whole_groups_in_order_and_cogroups(spark):
    rows = [("a", d, 0.0) for d in (5, 1, 2, 9, 3)] + [("b", 7, 0.0)]
    got = groups.map_groups(frame(spark, rows, 3), ["k"], runs, "first_day int, days int", ["day"]).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 3), ("a", 5, 1), ("a", 9, 1), ("b", 7, 1)]

    def sizes(left, right):
        return pa.table({"l": [left.num_rows], "r": [right.num_rows]})

    both = groups.map_cogroups(frame(spark, rows, 3), frame(spark, [("b", 1, 1.0), ("c", 1, 1.0)], 1), ["k"], sizes, "l long, r long")
    assert sorted(map(tuple, both.collect())) == [("a", 5, 0), ("b", 1, 1), ("c", 0, 1)]
    empty = frame(spark, [], 1)
    assert groups.map_groups(empty, ["k"], runs, "first_day int, days int", ["day"]).collect() == []
    assert groups.aggregate_groups(empty, ["k"], slope()).collect() == []
