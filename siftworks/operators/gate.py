"""Admission gates over raw problem records, and the counts they leave behind."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import classify, tags
from ..functions.text import byte_length, composite_id, value_or_default

ORIGINS = ("public", "private", "generated")


@dataclass(frozen=True)
class GateLimits:
    """All settings of the gates; each is a parameter, none is read from elsewhere."""

    exclude_sources: tuple[int, ...] = (0,)
    require_python3: bool = True
    python3: int = 3
    require_stdio: bool = True
    exclude_many_answers: bool = True
    exclude_interactive: bool = True
    most_seconds: float = 8.0
    default_seconds: float = 2.0
    default_memory: int = 268435456
    least_tests: int = 20
    most_tests: int = 300
    most_field_bytes: int = 65536
    most_description_bytes: int = 131072
    order: tuple[str, ...] = field(default=ORIGINS)


def reasons(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that hold, in order; a null check does not hold."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in checks)))


def retainable(cases: Column | str, limit: int, first: str = "input", second: str = "output") -> Column:
    """How many cases have both fields within the limit."""
    c = F.col(cases) if isinstance(cases, str) else cases
    return F.size(F.filter(c, lambda x: (F.octet_length(x[first]) <= limit) & (F.octet_length(x[second]) <= limit)))


def gate(problems: DataFrame, limits: GateLimits = GateLimits()) -> DataFrame:
    """Light metadata of each record with all reasons against it; no reason short-circuits another.

    A record whose decoding failed (``decode_error`` not null) has the one reason
    ``proto_error``. Null arrays count as empty.
    """
    empty = {f"{o}_tests": F.coalesce(F.col(f"{o}_tests"), F.array().cast(problems.schema[f"{o}_tests"].dataType)) for o in limits.order}
    df = problems.withColumns(empty)
    seconds, seconds_source = value_or_default("time_limit_seconds", limits.default_seconds)
    memory, memory_source = value_or_default(F.col("memory_limit_bytes").cast("double"), limits.default_memory)
    python3 = F.size(F.filter(F.coalesce("solutions", F.array().cast(problems.schema["solutions"].dataType)), lambda s: s["language"] == limits.python3))
    df = df.withColumns(
        {
            "time_limit_seconds": seconds,
            "time_limit_source": seconds_source,
            "memory_limit_bytes": memory.cast("long"),
            "memory_limit_source": memory_source,
            **{f"n_{o}": F.size(f"{o}_tests") for o in limits.order},
            **{f"n_retainable_{o}": retainable(f"{o}_tests", limits.most_field_bytes) for o in limits.order},
            "n_python3_solutions": python3,
            "description_bytes": byte_length("description"),
            "multiple_answer_hits": tags.many_answers("description"),
            "interactive_hits": tags.interactive("description"),
            "heuristic": classify.keyword_guess("description"),
        }
    )
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    kept = sum(F.col(f"n_retainable_{o}") for o in limits.order)
    given = sum(F.col(f"n_{o}") for o in limits.order)
    found = reasons(
        ("source_excluded", F.col("source").isin(*limits.exclude_sources)),
        ("no_python3_solution", F.lit(limits.require_python3) & (F.col("n_python3_solutions") == 0)),
        ("non_stdio", F.lit(limits.require_stdio) & ~(blank("input_file") & blank("output_file"))),
        ("multiple_answers", F.lit(limits.exclude_many_answers) & (F.size("multiple_answer_hits") > 0)),
        ("interactive", F.lit(limits.exclude_interactive) & (F.size("interactive_hits") > 0)),
        ("time_limit_too_large", F.col("time_limit_seconds") > limits.most_seconds),
        ("too_few_tests", kept < limits.least_tests),
        ("too_many_tests", given > limits.most_tests),
        ("description_too_large", F.col("description_bytes") > limits.most_description_bytes),
    )
    failed = F.col("decode_error").isNotNull() if "decode_error" in problems.columns else F.lit(False)
    df = df.withColumn("reject_reasons", F.when(failed, F.array(F.lit("proto_error"))).otherwise(found))
    return df.withColumns(
        {
            "cc_id": composite_id("split", "shard", "record_index"),
            "heuristic_category": F.col("heuristic.category"),
            "passed": F.size("reject_reasons") == 0,
        }
    ).drop("heuristic", *(f"{o}_tests" for o in limits.order), "solutions")


def funnel(rows: DataFrame, reason: str = "reject_reasons", passed: str = "passed") -> DataFrame:
    """(metric, n): all records, those passed, and how often each reason was given. One scan, partial sums before the exchange."""
    marks = F.concat(F.array(F.lit("records")), F.when(F.col(passed), F.array(F.lit("passed"))).otherwise(F.array().cast("array<string>")), F.transform(reason, lambda r: F.concat(F.lit("reason:"), r)))
    return rows.select(F.explode(marks).alias("metric")).groupBy("metric").agg(F.count("*").alias("n"))


#: What ``gate`` can give as a reason.
REASONS = ("source_excluded", "no_python3_solution", "non_stdio", "multiple_answers", "interactive", "time_limit_too_large", "too_few_tests", "too_many_tests", "description_too_large", "proto_error")


class Tally:
    """Counts that are taken while rows pass on their way to a sink, so that no second scan is needed.

    ``rows`` is to be written instead of the given ones; ``counts`` waits until that is done. Names with a
    count of 0 are left out, as in ``funnel``.
    """

    def __init__(self, rows: DataFrame, /, **counts: Column):
        self._names, self._seen = list(counts), Observation()
        self.rows = rows.observe(self._seen, *(n.alias(f"c{i}") for i, n in enumerate(counts.values())))

    def counts(self) -> dict[str, int]:
        seen = self._seen.get
        return {n: int(seen[f"c{i}"]) for i, n in enumerate(self._names) if seen[f"c{i}"]}


def tallied(rows: DataFrame, names: tuple[str, ...] = REASONS, reason: str = "reject_reasons", passed: str = "passed", **values: tuple[str, ...]) -> Tally:
    """The counts of ``funnel`` for known reasons (others together as ``reason:other``), and passed rows by the known ``values`` of columns."""
    known = F.array(*map(F.lit, names)).cast("array<string>")
    return Tally(
        rows,
        records=F.count(F.lit(1)),
        passed=F.count_if(passed),
        **{f"reason:{n}": F.count_if(F.array_contains(reason, n)) for n in names},
        **{"reason:other": F.sum(F.size(F.filter(reason, lambda r: ~F.array_contains(known, r))))},
        **{f"{column}:{v}": F.count_if(F.col(passed) & (F.col(column) == v)) for column, given in values.items() for v in given},
    )


def passed_by(rows: DataFrame, *keys: str, passed: str = "passed") -> DataFrame:
    return rows.where(passed).groupBy(*keys).agg(F.count("*").alias("n"))


def eligible(rows: DataFrame, categories: tuple[str, ...], bins: tuple[str, ...]) -> DataFrame:
    return rows.where(F.col("primary_category").isin(*categories) & F.col("difficulty_bin").isin(*bins))


def eligibility_counts(rows: DataFrame, categories: tuple[str, ...], bins: tuple[str, ...]) -> DataFrame:
    """Rows kept, and rows excluded for each of both reasons."""
    known, binned = F.col("primary_category").isin(*categories), F.col("difficulty_bin").isin(*bins)
    return rows.agg(
        F.count_if(known & binned).alias("eligible"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("no_category"),
        F.count_if(known & ~F.coalesce(binned, F.lit(False))).alias("no_bin"),
    )


def needs_number_tolerance(verdict: Column | str, failures: Column | str) -> Column:
    """A wrong answer whose failures are all wrong answers of equal token count."""
    from ..functions.compare import tokens

    f = F.col(failures) if isinstance(failures, str) else failures
    same = lambda x: (x["verdict"] == "WA") & (F.size(tokens(F.coalesce(x["stdout_head"], F.lit("")))) == F.size(tokens(F.coalesce(x["expected_head"], F.lit("")))))
    return (F.col(verdict) == "WA" if isinstance(verdict, str) else verdict == "WA") & (F.size(f) > 0) & F.forall(f, lambda x: F.coalesce(same(x), F.lit(False)))


def special_judge_suspected(attempts: Column | str) -> Column:
    """All attempts are wrong answers and some failure has the wanted number of tokens, which is not 0."""
    from ..functions.compare import tokens

    a = F.col(attempts) if isinstance(attempts, str) else attempts
    got, want = lambda x: F.size(tokens(x["stdout_head"])), lambda x: F.size(tokens(x["expected_head"]))
    near = lambda x: F.exists(x["failures"], lambda f: (got(f) == want(f)) & (want(f) > 0))
    return (F.size(a) > 0) & F.forall(a, lambda x: x["verdict"] == "WA") & F.exists(a, lambda x: F.coalesce(near(x), F.lit(False)))
