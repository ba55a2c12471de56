from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftworks.functions import classify, compare, tags, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("got", "want", "mode", "equal"),
    [
        ("3\n", "3", "token", True), ("1 2 3", "1\n2\n3", "token", True), ("1 2 3", "3 2 1", "token", False), ("3\n", "3\n\n", "exact", True),
        ("YES", "Impossible", "float", False), ("1 2", "1 2 3", "float", False), ("Case 1: 0.3333333", "Case 1: 0.33333333", "float", True),
        ("Case 1: 0.3", "Case 2: 0.3", "float", False), ("1,2", "1,3", "float", False), ("16.666666666666668", "16.6666666667", "float", True),
        ("5e-7", "1e-7", "float", True), ("0.5", "0.4", "float", False), ("1000000.9", "1000000.5", "float", True), ("1000002.5", "1000000.5", "float", False), ("nan", "1", "float", False),
    ],
)
def test_outputs(spark, got, want, mode, equal):
    assert one(spark, compare.outputs_equal("a", "b", mode), a=got, b=want) is equal


def test_unknown_mode():
    with pytest.raises(ValueError, match="unknown comparison mode"):
        compare.outputs_equal("a", "b", "fuzzy")


def test_mode_column(spark):
    rows = spark.createDataFrame([("1.0", "1.00000001", "float"), ("1.0", "1.1", "token")], "a string, b string, m string")
    assert [r[0] for r in rows.select(compare.outputs_equal_by("a", "b", "m")).collect()] == [True, False]


def test_float_mode_against_loop(spark):
    draw = random.Random(3)
    words = ["1", "1.0", "1.0000005", "2", "abc", "1e3", "1000.0001", ".5", "0.5000001", "3d"]
    pairs = [(" ".join(draw.choices(words, k=draw.randint(0, 3))), " ".join(draw.choices(words, k=draw.randint(0, 3)))) for _ in range(300)]

    def number(t):
        return float(t) if all(c in "0123456789.eE+-" for c in t) else None

    def loop(a, b):
        x, y = a.split(), b.split()
        return len(x) == len(y) and all(p == q or (None not in (number(p), number(q)) and abs(number(p) - number(q)) <= max(1e-6, 1e-6 * abs(number(q)))) for p, q in zip(x, y, strict=True))

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["v"] for r in rows.select("i", compare.outputs_equal("a", "b", "float").alias("v")).collect()}
    assert got == {i: loop(a, b) for i, (a, b) in enumerate(pairs)}


@pytest.mark.parametrize(
    ("given", "names"),
    [("This is an INTERACTIVE task", ["interactive_keyword"]), ("flush the output", ["flush_output"]), ("flushing", ["flush_output"]), ("print the query results", []), ("interact", []), ("", []), (None, [])],
)
def test_interactive(spark, given, names):
    rows = spark.createDataFrame([(given,)], "t string")
    assert rows.select(tags.interactive("t")).first()[0] == names


def test_other_tags(spark):
    assert "print_any" in one(spark, tags.many_answers("t"), t="If there are several answers, print any")
    assert one(spark, tags.many_answers("t"), t="print the answer") == []
    assert set(one(spark, tags.python2("t"), t="n = raw_input()\nprint n\nfor i in xrange(3): pass")) == {"raw_input", "xrange", "print_statement"}
    assert one(spark, tags.python2("t"), t="print(n)") == []


def test_keys_and_titles(spark):
    assert one(spark, text.link_key("u"), u="https://codeforces.com/contest/12/problem/b2") == "codeforces:12:B2"
    assert one(spark, text.link_key("u"), u=" https://atcoder.jp/contests/abc1/tasks/abc1_a?lang=en") == "atcoder:abc1:abc1_a"
    assert one(spark, text.link_key("u"), u="https://www.codechef.com/problems/ABC") == "codechef::ABC"
    assert one(spark, text.link_key("u"), u="https://example.com") is None
    assert one(spark, text.normalized_title("t"), t=" p123 Two-Sum! ") == "two sum"
    assert one(spark, text.title_candidates("t"), t="Round 5 - Two Sum") == ["round 5 two sum", "two sum"]
    assert one(spark, text.title_candidates("t"), t="") == []
    assert one(spark, text.row_key("s", "c", "i"), s="CODEFORCES", c=5, i=" a ") == "codeforces:5:A"
    assert one(spark, text.row_key("s", "c", "i"), s="AIZU", c=5, i="a") is None
    assert one(spark, text.composite_id("s", "a", "b"), s="train", a=3, b=17) == "cc-train-003-0017"
    assert tuple(one(spark, text.id_parts("s"), s="cc-train-003-0017")) == ("train", 3, 17)
    assert one(spark, text.id_parts("s"), s="nonsense") is None


@pytest.mark.parametrize(("given", "want"), [("['A', 'B']", ["A", "B"]), ('["x"]', ["x"]), ("a, b ,,c", ["a", "b", "c"]), ("", []), ("[]", [])])
def test_lists(spark, given, want):
    assert one(spark, text.text_list("t"), t=given) == want


def test_sections(spark):
    raw = "intro\n### S1 read\none\n## S2: think\ntwo\n\n## S1 again\nthree\n## S7 code\n```python\nprint(1)\n```\n"
    steps = one(spark, text.sections("t"), t=raw)
    assert steps == {"S1": "three", "S2": "two", "S7": "```python\nprint(1)\n```"}
    assert one(spark, text.code_block("t"), t=raw) == "print(1)"
    assert one(spark, text.missing_sections(text.sections(F.col("t"))), t=raw) == ["S3", "S4", "S5", "S6"]
    assert one(spark, text.merged_sections(F.create_map(F.lit("S1"), F.lit("a"), F.lit("S2"), F.lit("b")), F.create_map(F.lit("S2"), F.lit("c")))) == {"S1": "a", "S2": "c"}
    assert one(spark, text.sections("t"), t="none here") == {}


def test_small_scalars(spark):
    assert one(spark, text.comparison_mode("t"), t="exact") == "token"
    assert one(spark, text.comparison_mode("t"), t="  ") == "token"
    assert one(spark, text.comparison_mode("t"), t="float_tolerance") == "float"
    assert one(spark, text.language("t"), t=" Python3 ") == "python"
    assert [one(spark, text.step_rank("t"), t=s) for s in ("S1", "S7", "S9")] == [0, 6, 7]
    assert one(spark, text.width_bucket_label("n", 400), n=1250) == "1200-1599"
    assert one(spark, text.error_type("t"), t="e3 ") == "E3"
    assert one(spark, text.error_type("t"), t="bad") == "NONE"
    assert [one(spark, text.clamped_confidence("t"), t=t) for t in ("2", "0.25", "x")] == [1.0, 0.25, 0.5]
    assert one(spark, text.candidate_id("p", text.candidate_name("k", "s")), p="p1", k="injected", s="E2") == "p1#injected-E2"


def test_bins(spark):
    rows = spark.createDataFrame([(1100, 0, None), (0, 12, None), (None, 20, "hard"), (200000, 8, None), (None, 0, None)], "r int, d int, l string")
    assert [r[0] for r in rows.select(classify.pool_bin("r", "d")).collect()] == ["<1200", "2000-2399", "2000-2399", ">=2400", "unknown"]
    got = [tuple(r[0]) for r in rows.select(classify.sampling_bin("r", "l", "d")).collect()]
    assert got == [("<1200", "cf_rating"), ("1600-1999", "cc_enum"), ("1600-1999", "taco"), ("1200-1599", "cc_enum"), ("unrated", "none")]


def test_assignment(spark):
    rows = spark.createDataFrame([(["Greedy", "math"], ["Range Queries"], ""), (["dp"], [], ""), ([], [], "find the shortest path"), ([], [], "add two numbers")], "c array<string>, t array<string>, d string")
    got = [tuple(r[0]) for r in rows.select(classify.assignment("c", "t", "d")).collect()]
    assert got == [("DataStructure", "taco", ["range queries"]), ("DP", "cf_tags", ["dp"]), ("Graph", "heuristic", ["shortest path"]), ("unclassified", "unclassified", [])]
    assert rows.select(classify.categories_of("c", "t")).first()[0] == ["DataStructure", "Greedy", "Simulation"]
