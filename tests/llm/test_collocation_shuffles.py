"""Rows of a level are numbered after they met, so the numbers are not shuffled."""

from __future__ import annotations

from basketlake.llm.collocations import counted


def test_numbers_of_rows_do_not_travel(spark):
    rows = [(c, x, x % 3, x, 1 + c, None) for c in range(4) for x in range(20) if (x + c) % 4]
    state = spark.createDataFrame(rows + [(0, None, None, None, None, bytearray(b"x"))],
                                  "chunk bigint, x bigint, y bigint, code int, held bigint, codes binary")
    found = counted(state, ["x", "y"], 8)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1
    assert "monotonically_increasing_id" in plan.split("Exchange")[0]
    want: dict = {}
    for c, x, y, _, held, _ in rows:
        want[x, y] = want.get((x, y), 0) + held
    got = found.collect()
    assert {(r.chunk, r.x, r.y, r.code, r.f) for r in got} == {
        (c, x, y, code, want[x, y]) for c, x, y, code, _, _ in rows if want[x, y] >= 8}
    assert len({r.id for r in got}) == len({(r.x, r.y) for r in got}) == sum(r.own for r in got)
    assert len({(r.x, r.y, r.id) for r in got}) == len({r.id for r in got})
