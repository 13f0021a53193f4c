"""Every rule on JSON lines is broken by a row of the queries, and forms of times are those of the reference's language."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from curatrix.operators import json_rules
from curatrix.plans.catalog import ORACLE_SQL


@pytest.mark.parametrize("name", ["validate_thread_lines", "validate_account_lines", "validate_snapshot_lines"])
def test_every_rule_is_broken_by_a_row(spark, sf_dir, name, monkeypatch):
    rules, made = set(), json_rules.found
    monkeypatch.setattr(json_rules, "found", lambda rows, line, own, item=None: rules.update((s, n) for s, n, _ in own) or made(rows, line, own, item))
    query = __spark_entry__.queries()[name]
    query(spark, sf_dir)
    sql = ORACLE_SQL[name]
    assert len(rules) > 15
    assert not [r for r in rules if f"'{r[0]}', '{r[1]}'" not in sql]


def test_times(spark):
    texts = ["2024-01-01", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00+00:00", "2024-01-01 10:00", "2024-01-01T24:00:00", "2024-02-30", "2024-1-1", "2024", "", " ", "x", "2024-01-01T10:00:00.123456", "2024-01-01T10:61"]
    got = {r.t: r.ok for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_rules.is_time(F.col("t")).alias("ok")).collect()}

    def plain(text):
        try:
            return bool(text.strip()) and bool(dt.datetime.fromisoformat(text.replace("Z", "+00:00")))
        except ValueError:
            return False

    assert got == {t: plain(t) for t in texts if t != "2024-01-01T24:00:00"} | {"2024-01-01T24:00:00": False}


def test_empty_table(spark):
    lines = spark.createDataFrame([], "line long, value string")
    for found in (json_rules.thread_findings(lines, "value", "line", ["scam"]), json_rules.account_findings(lines, "value", "line", ["scam"]), json_rules.snapshot_findings(lines, "value", "line")):
        assert found.columns == ["line", "item", "severity", "rule"] and found.count() == 0


@pytest.mark.parametrize("findings", [lambda x: json_rules.thread_findings(x, "value", "line", ["scam"]), lambda x: json_rules.account_findings(x, "value", "line", ["scam"]), lambda x: json_rules.snapshot_findings(x, "value", "line")])
def test_lines_are_parsed_once(spark, findings):
    lines = spark.range(4).selectExpr("id AS line", "if(id % 2 = 0, concat('{\"id\":\"', id, '\"}'), '[') AS value")
    found = findings(lines)
    assert found.count() > 0
    assert str(found._jdf.queryExecution().optimizedPlan().toString()).count("parseJson") <= 2  # one parse names it twice at most
