"""Command line: ``python -m siftworks judge|evaluate|solve|benchmark|variants|ablation|repairs|candidates|build|profile|fields``."""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports
from .config import load, settings
from .operators import agents, candidates, external, metrics
from .plans import build, experiments
from .session import session
from .sources import dataset_dirs, messages, riegeli


def model_of(name: str) -> external.Model:
    """``module:function``, or a JSON file of [keyword, reply] pairs."""
    if name.endswith(".json"):
        return external.script([tuple(x) for x in json.loads(Path(name).read_text(encoding="utf-8"))])
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def one_problem(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """The problem of the arguments as a row, and its cases."""
    row = [(args.problem, args.problem, Path(args.problem).read_text(encoding="utf-8"), args.rating, args.seconds, args.comparison)]
    problems = spark.createDataFrame(row, "candidate string, pid string, statement string, rating int, seconds double, comparison string")
    reference = dataset_dirs.reference_file(spark, args.reference) if args.reference else spark.createDataFrame([(None, None)], "code string, language string")
    problems = problems.join(F.broadcast(reference.toDF("reference", "reference_language")), F.lit(True))  # one row to one row
    cases = dataset_dirs.tests_file(spark, args.tests).withColumn("pid", F.lit(args.problem))
    return problems, cases


def shown(rows: DataFrame, out: str | None) -> None:
    for row in rows.limit(1000).collect():
        given = row.asDict(True)
        page = reports.audit_html(given) if out and out.endswith(".html") else reports.audit_markdown(given)
        if out:
            Path(out).write_text(page, encoding="utf-8")
        else:
            print(page)


def judge(spark: SparkSession, args: argparse.Namespace) -> None:
    code = dataset_dirs.reference_file(spark, args.code)
    rows = code.select(F.lit(args.code).alias("candidate"), F.lit("p").alias("pid"), "code", "language", F.lit(args.seconds).alias("seconds"), F.lit(args.comparison).alias("comparison"))
    cases = dataset_dirs.tests_file(spark, args.tests).withColumn("pid", F.lit("p"))
    print(json.dumps(agents.judged(rows, cases, external.local_program(args.memory)).first().asDict()))


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    problems, cases = one_problem(spark, args)
    rows = problems.join(F.broadcast(dataset_dirs.solution_file(spark, args.solution)), F.lit(True))  # one row to one row
    runner = external.local_program(args.memory)
    ran = agents.judged(rows, cases, runner)
    made = agents.audit(rows, ran.select("candidate", "status"), model_of(args.model), runner)
    shown(rows.select("candidate", "steps", "code", "language").join(ran.drop("status"), "candidate").join(made, "candidate"), args.out)


def solve(spark: SparkSession, args: argparse.Namespace) -> None:
    shown(agents.solve_and_repair(*one_problem(spark, args), model_of(args.model), external.local_program(args.memory), args.repairs), args.out)


def problem_rows(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    listed = dataset_dirs.problems(spark, args.root)
    return listed.select("pid", F.col("pid").alias("candidate"), "statement", F.col("difficulty").alias("rating"), "reference", "reference_language", F.coalesce("time_limit_seconds", F.lit(args.seconds)).alias("seconds"), "comparison", "tags")


def benchmark(spark: SparkSession, args: argparse.Namespace) -> None:
    """All problems of a data set solved and mended: rates, by difficulty and by tag, with a page each where ``--out`` is given."""
    rows = problem_rows(spark, args)
    done = agents.solve_and_repair(rows, dataset_dirs.test_cases(spark, args.root), model_of(args.model), external.local_program(args.memory), args.repairs)
    scored = done.withColumns({"accepted": F.col("exec_status") == "AC", "error_type": F.coalesce("error_type", F.lit("NONE"))})
    if args.out:
        experiments.write_solver_run(done, args.out)
    for title, table in (("Rates", metrics.solver_rates(scored)), ("By difficulty", metrics.difficulty_breakdown(scored, "rating")), ("By tag", metrics.tag_breakdown(scored))):
        print(dataset_dirs.markdown(title, table))


def variants(spark: SparkSession, args: argparse.Namespace, ablation: bool = False) -> None:
    """Labelled variants of a data set evaluated, in all configurations of the ablation or in the full one."""
    found = dataset_dirs.variants(spark, args.root, args.private)
    records = experiments.evaluated(dataset_dirs.problems(spark, args.root), found, model_of(args.model), external.local_program(args.memory), ablation)
    print(json.dumps(experiments.write_evaluation(records, args.out), sort_keys=True))


def ablation(spark: SparkSession, args: argparse.Namespace) -> None:
    variants(spark, args, True)


def repairs(spark: SparkSession, args: argparse.Namespace) -> None:
    """The three ways to repair compared on all problems of a data set."""
    records = experiments.repair_experiment(problem_rows(spark, args), dataset_dirs.test_cases(spark, args.root), model_of(args.model), external.local_program(args.memory), args.repairs)
    table = dataset_dirs.markdown("Ways to repair", metrics.experiment(records).orderBy("strategy"))
    if args.out:
        records.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{args.out}/records")
        dataset_dirs.write_text(spark, f"{args.out}/summary.md", table)
    print(table)


def candidates_(spark: SparkSession, args: argparse.Namespace) -> None:
    """Candidates of all four kinds built, checked and written as bundles, with a report; violations end the run with 1."""
    rows = problem_rows(spark, args)
    made = experiments.built_candidates(rows, dataset_dirs.test_cases(spark, args.root), model_of(args.model), external.local_program(args.memory))
    broken = experiments.candidate_violations(made)
    dataset_dirs.write_bundles(made, args.out, args.private)
    print(dataset_dirs.markdown("Candidates", candidates.report(made)))
    print(dataset_dirs.markdown("Violations", broken))
    if not broken.isEmpty():
        raise SystemExit(1)


def build_(spark: SparkSession, args: argparse.Namespace) -> None:
    work = build.Build(spark, args.records, args.labels, args.work, load(args.settings) if args.settings else settings(), args.oversample, args.train_shards)
    for stage in build.STAGES[build.STAGES.index(args.first) : build.STAGES.index(args.last) + 1]:
        if stage == "verify":
            passed, rejects = work.verified(external.local_program(args.memory))
            print(f"verify: {passed.count()} passed, {rejects.count()} rejected")
        elif stage == "write":
            print(json.dumps(work.written(args.public, args.private, args.prune)["stale"]))
        else:
            print(f"{stage}: {({'pool': work.pool, 'enrich': work.enriched, 'sample': work.sampled}[stage])().count()} rows")


def profile(spark: SparkSession, args: argparse.Namespace) -> None:
    print(dataset_dirs.markdown("Record files", riegeli.file_profile(riegeli.scan_chunks(spark, args.records))))


def fields(spark: SparkSession, args: argparse.Namespace) -> None:
    """Field numbers found in record files beside those that are declared."""
    found = messages.inspected(riegeli.scan_records(spark, args.records)).orderBy("number")
    print(dataset_dirs.markdown("Fields", found.withColumns({"wire_types": F.col("wire_types").cast("string"), "samples": F.col("samples").cast("string")})))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftworks", description=__doc__)
    verbs = top.add_subparsers(required=True)
    for name, call in (("judge", judge), ("evaluate", evaluate), ("solve", solve), ("benchmark", benchmark), ("variants", variants), ("ablation", ablation), ("repairs", repairs), ("candidates", candidates_), ("build", build_), ("profile", profile), ("fields", fields)):
        p = verbs.add_parser(name)
        p.set_defaults(call=call)
        p.add_argument("--memory", type=int, default=512, help="MB that a program may have")
        p.add_argument("--seconds", type=float, default=2.0)
        p.add_argument("--comparison", default="token")
        if name in ("evaluate", "solve", "benchmark", "variants", "ablation", "repairs", "candidates"):
            p.add_argument("--model", required=True, help="module:function, or a JSON file of [keyword, reply] pairs")
            p.add_argument("--repairs", type=int, default=3)
            p.add_argument("--out", help="file of the report, .md or .html")
        if name in ("evaluate", "solve"):
            p.add_argument("--problem", required=True)
            p.add_argument("--reference")
            p.add_argument("--rating", type=int)
        if name in ("judge", "evaluate", "solve"):
            p.add_argument("--tests", required=True)
    verbs.choices["judge"].add_argument("--code", required=True)
    verbs.choices["evaluate"].add_argument("--solution", required=True)
    for name in ("benchmark", "variants", "ablation", "repairs", "candidates"):
        verbs.choices[name].add_argument("--root", required=True)
        verbs.choices[name].add_argument("--private", help="tree of the labels")
    p = verbs.choices["build"]
    for flag in ("--records", "--labels", "--work", "--public", "--private"):
        p.add_argument(flag, required=True)
    p.add_argument("--settings", help="JSON or YAML file")
    p.add_argument("--first", choices=build.STAGES, default=build.STAGES[0])
    p.add_argument("--last", choices=build.STAGES, default=build.STAGES[-1])
    p.add_argument("--oversample", type=float, default=1.4)
    p.add_argument("--train-shards", type=int)
    p.add_argument("--prune", action="store_true", help="remove problem directories that are no longer selected")
    for name in ("profile", "fields"):
        verbs.choices[name].add_argument("--records", required=True)
    return top


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(given)
    args.call(spark or session(), args)


if __name__ == "__main__":
    main()
