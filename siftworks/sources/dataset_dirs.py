"""Data sets of one directory per problem: statement, meta, tests, references, variants and labels; and the same as sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import case_bytes, comparison_mode, language, ordered_digest
from ..operators import select
from ..operators.validate import derived_labels, overlay, stale
from ..session import cut
from . import stores
from .stores import read_files, write_files

META = "id string, difficulty int, tags array<string>, comparison string, time_limit_seconds double, memory_limit_bytes long"
CASE = "input string, expected string"
#: Names of numbered cases, input and expected output.
NUMBERED = (("input{}.txt", "expected{}.txt"), ("{}.in", "{}.out"))
#: JSON is read whole or not at all: strings of any length, and no null for what is malformed.
WHOLE = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}
VARIANT = "name string, language string, code string, steps map<string,string>, label map<string,string>"


def _texts(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """pid and, under its name, the text of each of these files of every ``root/<pid>``, also below parts of the root; no row where there is none of them."""
    files = read_files(spark, root, *names)
    return files.select(F.element_at(F.split("folder", "/"), -1).alias("pid"), *(F.col(f"`{n}`").cast("string").alias(n) for n in names))


def problems(spark: SparkSession, root: str) -> DataFrame:
    """One row for each directory with a statement; id, comparison and limits fall back to defaults."""
    files = _texts(spark, root, "problem.md", "meta.json", "reference.py", "reference.cpp").toDF("pid", "statement", "meta", "py", "cpp").where("statement IS NOT NULL")
    df = files.withColumn("m", F.from_json("meta", META))
    return df.select(
        "pid",
        F.coalesce("m.id", "pid").alias("id"),
        "statement",
        F.col("m.difficulty").alias("difficulty"),
        F.coalesce("m.tags", F.array().cast("array<string>")).alias("tags"),
        comparison_mode(F.coalesce("m.comparison", F.lit(""))).alias("comparison"),
        F.col("m.time_limit_seconds").alias("time_limit_seconds"),
        F.round(F.col("m.memory_limit_bytes") / (1 << 20)).cast("int").alias("memory_limit_mb"),
        F.coalesce("py", "cpp").alias("reference"),
        F.when(F.col("py").isNotNull(), "python").when(F.col("cpp").isNotNull(), "cpp").alias("reference_language"),
    )


def test_cases(spark: SparkSession, root: str) -> DataFrame:
    """(pid, ord, input, expected) of every ``root/<pid>``, also below parts of the root: from tests.json, whose absent keys are empty.

    Where there is none, from the text files of ``tests`` under the first names of ``NUMBERED`` that are there, numbered from 1 up to their first gap.
    A tests.json that can't be read whole, or an input without its expected output, is an error.
    """
    files = stores.read_series(spark, root, "tests.json", "tests", NUMBERED)
    refused = lambda what: F.raise_error(F.concat_ws(" ", "folder", F.lit(what), "n"))
    text = lambda side: F.regexp_replace(F.col(side).cast("string"), "\r\n?", "\n")
    listed = F.coalesce(F.from_json(F.col("first").cast("string"), f"array<struct<{CASE}>>", WHOLE), refused("has a tests.json without an array"))
    numbered = F.array(F.struct(text("first").alias("input"), F.coalesce(text("second"), refused("lacks the expected output of case")).alias("expected")))
    cases = files.select(F.element_at(F.split("folder", "/"), -1).alias("pid"), "n", F.posexplode(F.when(F.col("n").isNull(), listed).otherwise(numbered)).alias("ord", "c"))
    return cases.select("pid", F.coalesce(F.col("n") - 1, "ord").alias("ord"), F.coalesce("c.input", F.lit("")).alias("input"), F.coalesce("c.expected", F.lit("")).alias("expected"))


def numbered_cases(spark: SparkSession, root: str) -> DataFrame:
    """Cases of ``tests/<n>.in`` and ``tests/<n>.out`` from 1, up to the first gap."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(r"/tests/\d+\.(in|out)$"))
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -3).alias("pid"), F.split(F.element_at(parts, -1), r"\."), F.col("content").cast("string").alias("text"))
    named = named.toDF("pid", "n", "text").select("pid", F.get("n", F.lit(0)).cast("int").alias("n"), F.get("n", F.lit(1)).alias("side"), "text")
    both = named.groupBy("pid", "n").agg(F.max(F.when(F.col("side") == "in", F.col("text"))).alias("input"), F.max(F.when(F.col("side") == "out", F.col("text"))).alias("expected")).dropna()
    from pyspark.sql.window import Window

    w = Window.partitionBy("pid").orderBy("n")
    return both.withColumn("ord", F.row_number().over(w)).where(F.col("n") == F.col("ord")).select("pid", (F.col("ord") - 1).alias("ord"), "input", "expected")


def variants(spark: SparkSession, public: str, private: str | None = None) -> DataFrame:
    """Candidates of both trees with their label: the variant's own, overlaid key by key by labels.json.

    A key that labels.json holds wins even with a null value; without a label
    ``process_valid`` is null. A private tree that does not exist adds nothing.
    """
    out = None
    for root in filter(None, (public, private)):
        each = _texts(spark, root, "variants.json").select("pid", F.explode(F.from_json("`variants.json`", f"array<struct<{VARIANT.replace(' string', ':string').replace(' map', ':map')}>>")).alias("v"))
        rows = each.select("pid", F.col("v.name").alias("name"), language(F.coalesce("v.language", F.lit("python"))).alias("language"), F.col("v.code").alias("code"), F.col("v.steps").alias("steps"), F.col("v.label").alias("own"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if private:
        held = _texts(spark, private, "labels.json").select("pid", F.explode(F.from_json(F.get_json_object("`labels.json`", "$.labels"), "map<string,map<string,string>>")).alias("name", "external"))
        out = out.join(held, ["pid", "name"], "left")
    else:
        out = out.withColumn("external", F.lit(None).cast("map<string,string>"))
    label = overlay(F.col("own"), F.col("external"))
    at = lambda k: F.try_element_at(F.col("label"), F.lit(k))
    out = out.withColumn("label", label)
    valid = at("process_valid").try_cast("boolean")
    return out.select(
        "pid", "name", "language", "code", "steps", at("kind").alias("kind"), valid.alias("process_valid"), at("first_error").alias("first_error"), at("error_type").alias("error_type"),
        at("exec_status").alias("exec_status"), derived_labels(valid, at("exec_status")).alias("ac_but_invalid"),
    )


def solutions(answers: DataFrame) -> DataFrame:
    """Solution JSON (``text``) in its full or short form as steps and code."""
    full = F.from_json("text", "steps array<struct<step_id:string,title:string,content:string>>, code string")
    short = F.from_json("text", "map<string,string>")
    ids = F.transform(full["steps"], lambda s: F.regexp_replace(F.upper(F.trim(s["step_id"])), "^S0+", "S"))
    listed = F.filter(F.arrays_zip(ids.alias("k"), F.transform(full["steps"], lambda s: s["content"]).alias("v")), lambda x: x["k"].rlike("^S[1-7]$"))
    keys = F.array_distinct(F.transform(listed, lambda x: x["k"]))
    steps = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(listed, lambda x: x["k"] == k), -1)["v"]))
    code = F.get_json_object("text", "$.code")
    inner = F.get_json_object("text", "$.code.code")
    return answers.withColumns(
        {
            "steps": F.when(full["steps"].isNotNull(), steps).otherwise(F.map_filter(short, lambda k, _: k.rlike("^S[1-7]$"))),
            "code": F.coalesce(inner, code),
            "language": language(F.coalesce(F.get_json_object("text", "$.code.language"), F.lit("python"))),
        }
    )


def write_bundles(rows: DataFrame, public: str, private: str) -> None:
    """Variants routed by kind as partitioned tables: correct and natural ones public without any label, the others private; all labels private."""
    unlabelled = ["pid", "name", "language", "code", "steps"]
    open_ = F.col("kind").isin("correct", "natural")
    rows.where(open_).select(*unlabelled).write.mode("overwrite").partitionBy("pid").json(f"{public}/variants")
    rows.where(~F.coalesce(open_, F.lit(False))).select(*unlabelled).write.mode("overwrite").partitionBy("pid").json(f"{private}/variants")
    rows.select("pid", "name", "kind", "process_valid", "first_error", "error_type", "exec_status").write.mode("overwrite").partitionBy("pid").json(f"{private}/labels")


def write_problems(problem_rows: DataFrame, cases: DataFrame, root: str) -> None:
    """Problems and cases as Parquet, clustered by pid, so that one problem is read from few files."""
    problem_rows.repartitionByRange("pid").sortWithinPartitions("pid").write.mode("overwrite").parquet(f"{root}/problem")
    cases.repartitionByRange("pid", "ord").sortWithinPartitions("pid", "ord").write.mode("overwrite").parquet(f"{root}/case")


#: Columns of a verified row that meta.json holds, under these names.
META_COLUMNS = {
    "name": "name", "source_name": "source", "cf_rating": "difficulty", "difficulty_name": "difficulty_name", "difficulty_bin": "difficulty_bin", "difficulty_bin_source": "difficulty_bin_source", "primary_category": "category", "category_source": "category_source",
    "category_matched": "category_matched", "categories_all": "categories_all", "cf_tags": "tags", "taco_tags": "taco_tags", "taco_skill_types": "taco_skill_types", "taco_difficulty": "taco_difficulty", "taco_match": "taco_match", "taco_url": "taco_url",
    "time_limit_seconds": "time_limit_seconds", "time_limit_source": "time_limit_source", "memory_limit_bytes": "memory_limit_bytes", "comparison": "comparison", "n_python3_solutions": "n_python3_solutions",
}


def export_problems(rows: DataFrame, public: str, private: str, most_cases: int = 30, most_field_bytes: int = 32 << 10, most_bytes: int = 256 << 10) -> DataFrame:
    """A directory for each verified problem: problem.md, meta.json, tests.json and reference.py; verification.json in the private tree.

    ``rows``: cc_id, description, tests of each origin, code, attempts, max_ms and the
    columns of ``META_COLUMNS``. The cases are the longest prefix of the selected ones that fits.
    Both roots are in any store that ``stores`` knows. Files are staged and appear when all of a tree
    has been written, the private tree first, so a problem that is shown has its proof. Returns cc_id, n_cases,
    bytes and the cases' digest.
    """
    from ..operators.gate import ORIGINS

    rows = cut(rows)
    origins = F.array(*(F.struct(F.lit(o).alias("origin"), F.coalesce(F.col(f"{o}_tests"), F.array().cast(rows.schema[f"{o}_tests"].dataType)).alias("tests")) for o in ORIGINS))
    each = rows.select(F.col("cc_id").alias("pid"), F.explode(origins).alias("o")).select("pid", "o.origin", F.posexplode("o.tests").alias("ord", "t")).select("pid", "origin", "ord", "t.input", "t.output")
    picked = select.select_cases(each, most_cases, most_field_bytes)
    size = F.octet_length("input") + F.octet_length("output")
    picked = select.bounded_prefix(picked, ["pid"], ["position"], size, most_cases, most_bytes)
    cases = picked.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("position", "input", F.col("output").alias("expected"), "origin"))).alias("cases"))
    empty = F.array().cast(cases.schema["cases"].dataType)
    both = rows.withColumnRenamed("cc_id", "pid").join(cases, "pid", "left").withColumn("cases", F.coalesce("cases", empty))
    tests = F.to_json(F.transform("cases", lambda c: F.struct(c["input"].alias("input"), c["expected"].alias("expected"))))
    digest = ordered_digest("cases")
    of = lambda o: F.size(F.filter("cases", lambda c: c["origin"] == o))
    by_origin = F.map_from_arrays(F.array(*map(F.lit, ORIGINS)), F.array(*map(of, ORIGINS)))
    made_of = F.struct(F.size("cases").alias("total"), by_origin.alias("by_origin"), digest.alias("cases_digest"))
    given = [F.col(c).alias(n) for c, n in META_COLUMNS.items() if c in rows.columns]
    meta = F.to_json(F.struct(F.col("pid").alias("id"), *given, made_of.alias("tests"), F.struct(F.lit("python").alias("language"), F.sha2("code", 256).alias("sha256"), F.lit(True).alias("verified")).alias("reference")))
    proof = F.to_json(F.struct(F.col("pid").alias("pid"), "comparison", "attempt", "max_ms", F.size("attempts").alias("tried"), F.transform("attempts", lambda a: F.struct(a["attempt"].alias("attempt"), a["verdict"].alias("verdict"))).alias("attempts")))
    files = both.select("pid", F.coalesce("description", F.lit("")).alias("problem_md"), meta.alias("meta_json"), tests.alias("tests_json"), F.col("code").alias("reference_py"), proof.alias("verification_json"), F.size("cases").alias("n_cases"), case_bytes("cases").alias("bytes"), digest.alias("digest"))

    files = cut(files)
    named = lambda name, column: F.struct(F.concat("pid", F.lit(f"/{name}")).alias("name"), F.col(column).alias("text"))
    shown = F.array(named("problem.md", "problem_md"), named("meta.json", "meta_json"), named("tests.json", "tests_json"), named("reference.py", "reference_py"))
    write_files(files.select(named("verification.json", "verification_json").alias("f")).select("f.*"), private)
    write_files(files.select(F.explode(shown).alias("f")).select("f.*").where("text IS NOT NULL"), public)
    return files.select(F.col("pid").alias("cc_id"), F.col("n_cases").cast("int").alias("n_cases"), F.col("bytes").cast("long").alias("bytes"), "digest")


def filesystem(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's, in any store that Spark writes."""
    system, place = filesystem(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    """Removes what is at the place, in any store."""
    system, place = filesystem(spark, path)
    system.delete(place, True)


def prune(spark: SparkSession, root: str, keep: DataFrame, delete: bool = False) -> list[str]:
    """Problem directories under the root that are not in ``keep`` (pid), by name; with ``delete`` those that could not be removed.

    The listing is the driver's; files beside the directories are left alone.
    """
    system, place = filesystem(spark, root)
    present = [(s.getPath().getName(),) for s in system.listStatus(place) if s.isDirectory()]
    found = sorted(r[0] for r in stale(spark.createDataFrame(present, "pid string"), keep, "pid").collect())
    if not delete:
        return found
    return [name for name in found if not system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name), True)]


def manifest(config: dict, most: int = 10_000, **stages: DataFrame) -> str:
    """Settings and the small aggregate of each stage as JSON; a stage of more rows than ``most`` is refused."""
    out: dict = {"config": config}
    for name, df in stages.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"stage {name} is no small aggregate")
        out[name] = [r.asDict(True) for r in rows]
    return json.dumps(out, ensure_ascii=False, sort_keys=True, default=str)


def tests_file(spark: SparkSession, path: str) -> DataFrame:
    """(ord, input, expected) of one file of tests."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{CASE}>>")).alias("ord", "c")).select("ord", F.coalesce("c.input", F.lit("")).alias("input"), F.coalesce("c.expected", F.lit("")).alias("expected"))


def reference_file(spark: SparkSession, path: str) -> DataFrame:
    """(code, language) of one source file, by its ending."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("code"), F.lit("cpp" if path.endswith((".cpp", ".cc", ".cxx")) else "python").alias("language"))


def solution_file(spark: SparkSession, path: str) -> DataFrame:
    """(steps, code, language) of one solution file in its full or short form."""
    return solutions(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")).select("steps", "code", "language")


def bundles(spark: SparkSession, root: str, most_memory_mb: int) -> DataFrame:
    """Problems with a reference and their tests as one row each, with the memory that a run of them gets."""
    cases = test_cases(spark, root).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("ord", "input", "expected"))).alias("cases"))
    rows = problems(spark, root).where("reference is not null").join(cases, "pid")
    return rows.withColumn("memory_mb", memory_limit(F.nullif("memory_limit_mb", F.lit(0)), most_memory_mb))


def read_pool(spark: SparkSession, path: str, schema: str, passed_only: bool = False) -> DataFrame:
    """JSON lines under a fixed schema; never inferred."""
    rows = spark.read.schema(schema).json(path)
    return rows.where("passed") if passed_only else rows


def write_pool(rows: DataFrame, path: str) -> None:
    """JSON lines. For the counts of what is written give ``gate.tallied(rows).rows``: they are taken in the same scan."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows of Parquet files with ``ord``, their place by file and row: the same however files are split among tasks."""
    if "ord" in rows.columns:
        return rows
    return rows.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def extract_index(spark: SparkSession, raw: str, columns: list[str], out: str) -> DataFrame:
    """Only the wanted columns of all shards as one table, with ``ord``; the reader fetches no other column."""
    in_file_order(spark.read.parquet(raw)).select(*columns, "ord").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def memory_limit(own: Column, cap: int) -> Column:
    return F.when(own.isNotNull(), F.least(own, F.lit(cap))).otherwise(F.lit(cap))


def markdown(title: str, rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    head = rows.columns
    body = [[("" if v is None else str(v)) for v in r] for r in rows.limit(most).collect()]
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(head), line(["---"] * len(head)), *map(line, body), ""])
