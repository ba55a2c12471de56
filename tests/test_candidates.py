from __future__ import annotations

import functools
import http.server
import json
import threading

from test_agents import BAD, GOOD, cases, problems, solution

from siftworks.operators import candidates, external, validate
from siftworks.sources import acquire


def test_candidates(spark):
    replies = [
        ("Put one error", f"## S1\nno\n## S2\nwrong two\n## S3\nwrong three\n## S4\nwrong four\n## S5\nw\n## S6\nw\n## S7\ncode\n```python\n{BAD}\n```"), ("Give step", "## S3\nwrong reason\n## S4\nnot asked for\n"),
        ("natural", solution(BAD)), ("Solve the problem.", solution(GOOD)),
    ]
    model, runner = external.script(replies), external.local_program()
    given = problems(spark, "p", "q").drop("reference", "reference_language", "rating")
    base = candidates.correct(given, cases(spark, "p", "q"), model, runner)
    assert base.count() == 2 and {r["exec_status"] for r in base.collect()} == {"AC"}
    put = candidates.injected(base, cases(spark, "p", "q"), model, runner)
    got = {r["candidate"]: r for r in put.collect()}
    assert set(got) == {"p#injected-1", "p#injected-2", "q#injected-1", "q#injected-2"}
    assert all(r["exec_status"] == "WA" and r["process_valid"] is False and not r["ac_but_invalid"] for r in got.values())
    assert [got[k]["first_error"] for k in sorted(got)] == ["S2", "S3", "S4", "S5"] and got["p#injected-2"]["steps"]["S2"] != "wrong two" and got["p#injected-2"]["steps"]["S3"] == "wrong three"
    sly = candidates.accepted_invalid(base, cases(spark, "p", "q"), model, runner)
    # The model answers for S3 only, so the problem whose turn is S4 gets its S4, and nothing else changes.
    assert all(r["exec_status"] == "AC" and r["ac_but_invalid"] for r in sly.collect()) and sly.count() == 2
    raw = candidates.natural(given, cases(spark, "p", "q"), model, runner)
    assert {r["exec_status"] for r in raw.collect()} == {"AC"} and {r["process_valid"] for r in raw.collect()} == {None}
    columns = ["pid", "name", "kind", "steps", "code", "first_error"]
    every = put.select(columns).unionByName(sly.select(columns)).unionByName(base.selectExpr("pid", "'correct' as name", "'correct' as kind", "steps", "code", "cast(null as string) as first_error"))
    assert validate.against_base(every).count() == 0
    told = {(r["column"], r["value"]): r["n"] for r in candidates.report(put.unionByName(sly)).collect()}
    assert told["kind", "injected"] == 4 and told["ac_but_invalid", "true"] == 2 and told["injection", "accepted"] == 0


def test_downloads(tmp_path):
    (tmp_path / "site").mkdir()
    (tmp_path / "site/a.parquet").write_bytes(b"x" * 3_000_000)
    (tmp_path / "site/list.json").write_text(json.dumps([{"path": "a.parquet"}, "readme.md"]))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=tmp_path / "site"))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/list.json"
    assert [p.stat().st_size for p in acquire.fetch_all(url, str(tmp_path / "got"))] == [3_000_000]
    assert acquire.fetched(url.replace("list.json", "a.parquet"), str(tmp_path / "got"))[1] is False
    assert not list((tmp_path / "got").glob("*.part"))
    server.shutdown()
