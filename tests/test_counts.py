"""Ids of rows without one."""

from curatrix.operators import counts


def test_null_ids_are_unique_beyond_four_digits(spark):
    for largest in (7, 9_990, 12_340):
        rows = [(0, f"x_{largest}"), *((k, None) for k in range(1, 41))]
        out = counts.assign_null_ids(spark.createDataFrame(rows, "line long, id string")).collect()
        assert {r.line: r.id for r in out} == {0: f"x_{largest}"} | {k: f"x_auto_{largest + k:04d}" for k in range(1, 41)}
