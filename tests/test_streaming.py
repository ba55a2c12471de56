from __future__ import annotations

from siftworks.streaming import funnel


def test_funnel_over_a_directory(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.json").write_text('{"passed": true, "reject_reasons": []}\n{"passed": false, "reject_reasons": ["a", "b"]}\n')
    rows = funnel.read_lines(spark, str(tmp_path / "in"), "passed boolean, reject_reasons array<string>", 1)
    q = funnel.start(funnel.counted(rows), "funnel_counts", "complete", str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert {r["metric"]: r["n"] for r in spark.table("funnel_counts").collect()} == {"records": 6, "passed": 3, "reason:a": 3, "reason:b": 3}
