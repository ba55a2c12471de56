"""Queries over record files and messages that are made of the driver's tables, and the SQL each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_root, cut
from ..operators import candidates, gate
from ..sources import dataset_dirs, messages, riegeli, stores
from . import build, data_queries
from .tables import table

#: Ids of one record file, or of one part of a tree of directories; these grow in number with the table.
SHARD_IDS = 1000


def _dealt(documents: DataFrame) -> DataFrame:
    """Every document with its split and shard."""
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "valid").otherwise("train")
    return documents.select("doc_id", "text", split.alias("split"), F.floor(F.col("doc_id") / SHARD_IDS).cast("int").alias("shard"))


def _over_files(spark: SparkSession, sf_dir: str, query: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What a query makes of record files with a record ``id, line end, text`` for each document; the files are removed then."""
    documents = _dealt(table(spark, sf_dir, "documents"))
    folder = f"{checkpoint_root(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    raw = F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary")
    riegeli.write_records(documents.select("split", "shard", F.col("doc_id").alias("ord"), raw.alias("raw")), folder, name="documents")
    found = cut(query(documents, folder))
    dataset_dirs.remove(spark, folder)
    return found


def _read(records: DataFrame) -> tuple[Column, Column]:
    """Id and text of a record."""
    whole = F.col("raw").cast("string")
    own = F.substring_index(whole, "\n", 1)
    return own.cast("long").alias("doc_id"), F.sha2(F.substring(whole, F.length(own) + 2, F.length(whole)), 256).alias("text_sha256")


def q68_record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all files, in ranges that are cut anywhere: each with its place in its shard."""

    def query(_: DataFrame, folder: str) -> DataFrame:
        records = riegeli.scan_records(spark, folder, range_bytes=2 * riegeli.BLOCK)
        return records.select("split", "shard", F.col("record_index").cast("long").alias("record_index"), *_read(records))

    return _over_files(spark, sf_dir, query)


def q69_file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file: its records and the bytes they unpack to, from chunk headers only."""

    def query(_: DataFrame, folder: str) -> DataFrame:
        profile = riegeli.file_profile(riegeli.scan_chunks(spark, folder, range_bytes=4 * riegeli.BLOCK))
        name = F.element_at(F.split("path", "/"), -1)
        return profile.select(name.alias("file"), "signature_ok", "records", "decoded_bytes", F.col("error").isNull().alias("whole"))

    return _over_files(spark, sf_dir, query)


def q70_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the documents that labels call toxic, looked up by shard and place through the index of chunks."""

    def query(documents: DataFrame, folder: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("split", "shard").orderBy("doc_id")) - 1  # a shard has few ids
        placed = documents.select("doc_id", "split", "shard", place.alias("record_index"))
        toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
        ids = placed.join(toxic, "doc_id", "left_semi").select("split", "shard", "record_index")
        records = riegeli.scan_records(spark, folder, ids=ids, index=riegeli.chunk_index(spark, folder))
        return records.select("split", "shard", F.col("record_index").cast("long").alias("record_index"), *_read(records))

    return _over_files(spark, sf_dir, query)


def q73_counted_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gated documents written as JSON lines, and their funnel as it was counted by that write."""
    rows = data_queries.gated_documents(spark, sf_dir)
    tally = gate.tallied(rows, ("lang_excluded", "too_large", "too_short", "has_digit", "shouting"))
    place = f"{checkpoint_root(spark).rstrip('/')}/pool-{uuid.uuid4().hex}"
    dataset_dirs.write_pool(tally.rows, place)
    written = dataset_dirs.read_pool(spark, place, "doc_id long, passed boolean, reject_reasons array<string>")
    checked = cut(written.groupBy(F.when(F.col("passed"), "passed").otherwise("rejected").alias("metric")).agg(F.count("*").alias("n")).where("metric = 'rejected'"))
    dataset_dirs.remove(spark, place)
    counted = spark.createDataFrame(sorted(tally.counts().items()), "metric string, n long")
    return counted.unionByName(checked)


def q74_problem_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as problem directories, all files together in parts of the tree, and read again: statement, meta and every case. A tenth have their cases as numbered text files."""
    suppliers = table(spark, sf_dir, "supplier").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")  # few bytes, many files
    pid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    part = F.floor(F.col("s_suppkey") / SHARD_IDS).cast("string")
    meta = F.to_json(F.struct((F.col("s_suppkey") * 10).alias("difficulty"), F.array(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("tags"), F.when(F.col("s_nationkey") > 12, "float").alias("comparison"), F.lit(256 << 20).alias("memory_limit_bytes")))
    cases = [(F.concat(F.col("s_name"), F.lit(f" {i}")), F.when(F.col("s_nationkey") > i * 8, F.col("s_nationkey").cast("string"))) for i in range(3)]
    named = lambda n, c: F.struct(F.concat(part, F.lit("/"), pid, F.lit(f"/{n}")).alias("name"), c.alias("text"))
    listed = F.array(named("tests.json", F.to_json(F.array(*(F.struct(given.alias("input"), expected.alias("expected")) for given, expected in cases)))))
    numbered = F.array(*(named(f"tests/{n}{i}.txt", F.coalesce(c, F.lit(""))) for i, case in enumerate(cases, 1) for n, c in zip(("input", "expected"), case, strict=True)))
    files = F.concat(F.array(named("problem.md", F.col("s_name")), named("meta.json", meta)), F.when(F.col("s_suppkey") % 10 == 0, numbered).otherwise(listed))
    place = f"{checkpoint_root(spark).rstrip('/')}/problems-{uuid.uuid4().hex}"
    stores.write_files(suppliers.select(F.explode(files).alias("f")).select("f.*"), place)
    given = dataset_dirs.test_cases(spark, place).groupBy("pid").agg(F.count("*").alias("n_cases"), F.count_if(F.col("expected") == "").alias("n_empty"), F.min("input").alias("first_input"))
    shown = dataset_dirs.problems(spark, place).select("pid", "statement", "difficulty", F.array_join("tags", ",").alias("tags"), "comparison", "memory_limit_mb")
    found = cut(shown.join(given, "pid"))
    stores.remove_files(spark, place)
    return found


def q75_bundles_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as labelled variants in a public and a private tree: what each shows of every kind."""
    at = F.col("s_suppkey")
    kind = F.when(at % 4 == 0, "correct").when(at % 4 == 1, "natural").when(at % 4 == 2, "injected").otherwise("ac_invalid")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("p"), (at % 7).cast("string")).alias("pid"), F.concat(kind, F.lit("-"), at.cast("string")).alias("name"), F.lit("python").alias("language"), F.col("s_name").alias("code"), F.create_map(F.lit("S1"), F.col("s_name")).alias("steps"),
        kind.alias("kind"), F.when(kind != "natural", kind == "correct").alias("process_valid"), F.when(kind.isin("injected", "ac_invalid"), "S2").alias("first_error"), F.lit("E2").alias("error_type"), F.when(kind == "injected", "WA").otherwise("AC").alias("exec_status"),
    )
    place = f"{checkpoint_root(spark).rstrip('/')}/bundles-{uuid.uuid4().hex}"
    dataset_dirs.write_bundles(rows, f"{place}/public", f"{place}/private")
    variants = "name string, language string, code string, steps map<string,string>, pid string"
    shown = spark.read.schema(variants).json(f"{place}/public/variants").withColumn("tree", F.lit("public"))
    hidden = spark.read.schema(variants).json(f"{place}/private/variants").withColumn("tree", F.lit("private"))
    labels = spark.read.schema("name string, process_valid boolean, first_error string, pid string").json(f"{place}/private/labels")
    both = shown.unionByName(hidden).join(labels, ["pid", "name"], "left")
    found = cut(both.groupBy("tree", "pid", F.substring_index("name", "-", 1).alias("kind")).agg(F.count("*").alias("n"), F.count_if("process_valid").alias("valid"), F.count("first_error").alias("with_error"), F.min("code").alias("first_code")))
    dataset_dirs.remove(spark, place)
    return found


def q76_candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates: kinds, statuses, error types and first errors, with accepted-but-invalid ones and failed injections."""
    at = F.col("doc_id")
    kind = F.when(at % 3 == 0, "injected").when(at % 3 == 1, "ac_invalid").otherwise("natural")
    rows = table(spark, sf_dir, "documents").select(
        kind.alias("kind"), F.when(F.length("text") > 1500, "AC").otherwise("WA").alias("exec_status"), F.concat(F.lit("E"), (1 + at % 8).cast("string")).alias("error_type"), F.when(kind != "natural", F.concat(F.lit("S"), (1 + F.length("text") % 7).cast("string"))).alias("first_error"),
        ((kind == "ac_invalid") & (F.length("text") > 1500)).alias("ac_but_invalid"),
    )
    return candidates.report(rows)


def q77_label_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labels would have given documents: tags, skills, bins and categories."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") == "en", F.array("source")).when(F.col("lang") == "de", none).alias("taco_tags"), F.when(F.length("text") > 2000, F.array(F.lit("long"))).otherwise(none).alias("taco_skill_types"),
        F.when(F.col("source").contains("e"), "taco").otherwise("rating").alias("difficulty_bin_source"), F.when(F.col("text").contains("?"), "taco").alias("category_source"),
    )
    return build.impact(rows)


def q78_verification_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as selected problems and their labels as verification results: who passed, and why the others did not."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cc_id"), F.col("source").alias("name"))
    attempt = lambda verdict, got, want: F.struct(verdict.alias("verdict"), F.array(F.struct(F.lit(got).alias("stdout_head"), F.lit(want).alias("expected_head"))).alias("failures"))
    first = F.when(F.col("toxic") == 1, "WA").otherwise("RE")
    tried = F.when(F.col("quality") == 1, F.array(attempt(F.lit("AC"), "1 2", "1 2"))).otherwise(F.array(attempt(F.lit("WA"), "1 2", "3 4"), attempt(first, "1", "1 2")))
    results = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("cc_id")).agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    results = results.select("cc_id", tried.alias("attempts"), F.when(F.col("quality") == 1, "token").alias("comparison"), F.concat(F.lit("code "), F.col("cc_id").cast("string")).alias("code"))
    passed, rejects = build.split_by_verification(docs, results)
    none = F.lit(None)
    return passed.select("cc_id", "name", "reference_sha256", none.cast("int").alias("tried"), none.cast("string").alias("reasons"), none.cast("boolean").alias("suspected")).unionByName(
        rejects.select("cc_id", "name", none.cast("string").alias("reference_sha256"), "tried", F.array_join("reasons", ",").alias("reasons"), "suspected")
    )


def _varint(value: Column, bits: int = 35) -> Column:
    """A number below ``2 ** bits`` as hexadecimal digits of its varint."""
    value, digits = value.cast("long"), []
    for at in range(0, bits, 7):
        more = F.when(value >= 1 << (at + 7), 0x80).otherwise(0)
        digits.append(F.when((value >= 1 << at) | F.lit(at == 0), F.lpad(F.hex((F.shiftright(value, at) % 128 + more).cast("long")), 2, "0")).otherwise(""))
    return F.concat(*digits)


def _number(field: int, value: Column) -> Column:
    return F.concat(_varint(F.lit(field << 3)), _varint(value))


def _text(field: int, value: Column) -> Column:
    """A text, or a nested message as hexadecimal digits, as a field."""
    return F.concat(_varint(F.lit(field << 3 | 2)), _varint(F.octet_length(value)), F.hex(value.cast("binary")))


def _nested(field: int, *parts: Column) -> Column:
    inside = F.concat(*parts)
    return F.concat(_varint(F.lit(field << 3 | 2)), _varint(F.length(inside) / 2), inside)


def q71_decoded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a message of numbers, texts, repeated texts and nested messages, built of column expressions and decoded by batches."""
    text = lambda c: F.col(c).cast("string")
    raw = F.concat(
        _text(1, F.concat(F.lit("zeilé "), text("l_orderkey"))),
        _number(6, F.col("l_linenumber")),
        _number(7, F.col("l_suppkey") % 40),
        _number(10, F.col("l_orderkey")),
        _number(14, F.lit(7)),
        _number(14, F.col("l_partkey")),
        _text(15, F.col("l_returnflag")),
        _nested(4, _text(1, text("l_suppkey")), _text(2, F.repeat(F.col("l_linestatus"), F.col("l_linenumber") * 40))),
        _nested(8, _number(1, F.col("l_linenumber")), _text(2, text("l_partkey"))),
        _text(15, F.col("l_linestatus")),
        F.repeat(_nested(19, _number(1, F.lit(3))), (F.col("l_quantity") % 5).cast("int")),
        _nested(4, _text(2, F.col("l_returnflag"))),
        _nested(29, _number(1, F.col("l_linenumber")), _number(2, F.lit(500_000_000))),
        _number(900, F.col("l_orderkey")),
    )
    lines = table(spark, sf_dir, "lineitem").select(F.lit("train").alias("split"), F.col("l_linenumber").cast("int").alias("shard"), F.lit(0).alias("record_index"), F.unhex(raw).alias("raw"))
    case = lambda i, side: F.get("public_tests", F.lit(i))[side]
    return messages.with_names(messages.decode_problems(lines)).select(
        "name", "source_name", "difficulty_name", F.col("cf_contest_id").alias("l_orderkey"), F.col("cf_rating").alias("l_partkey"), F.col("shard").alias("l_linenumber"), F.array_join("cf_tags", ",").alias("tags"), F.size("public_tests").alias("n_cases"),
        case(0, "input").alias("first_input"), F.length(case(0, "output")).alias("output_length"), case(1, "input").alias("second_input"), case(1, "output").alias("second_output"),
        F.get("solutions", F.lit(0))["language"].alias("code_language"), F.get("solutions", F.lit(0))["solution"].alias("code"), "n_incorrect_solutions", "time_limit_seconds", F.col("decode_error").isNull().alias("whole"),
    )


def q79_shard_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files by split and shard in their order, of the training split the first three."""
    return _over_files(spark, sf_dir, lambda _, folder: riegeli.shards(spark, folder, train_shards=3).select("split", "shard", "ord", F.element_at(F.split("path", "/"), -1).alias("file")))


def _named_sql(code: str, names: dict[int, str]) -> str:
    return f"CASE {code} {' '.join(f'WHEN {k} THEN {v!r}' for k, v in names.items())} ELSE 'UNKNOWN_' || {code} END"


_DEALT = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'valid' ELSE 'train' END AS split,
  floor(doc_id / {SHARD_IDS})::INTEGER AS shard FROM documents)"""
_PLACED = f"""WITH {_DEALT},
p AS (SELECT split, shard, row_number() OVER (PARTITION BY split, shard ORDER BY doc_id) - 1 AS record_index, doc_id, sha256(text) AS text_sha256 FROM d)
SELECT * FROM p"""

QUERIES = {"q68_record_scan": q68_record_scan, "q69_file_profile": q69_file_profile, "q70_point_lookup": q70_point_lookup, "q71_decoded_messages": q71_decoded_messages, "q73_counted_write": q73_counted_write,
           "q74_problem_directories": q74_problem_directories, "q75_bundles_apart": q75_bundles_apart, "q76_candidate_report": q76_candidate_report, "q77_label_impact": q77_label_impact, "q78_verification_split": q78_verification_split, "q79_shard_listing": q79_shard_listing}
SQL = {
    "q68_record_scan": _PLACED,
    "q69_file_profile": f"""WITH {_DEALT}
SELECT 'documents_' || split || '.riegeli-' || lpad(shard::VARCHAR, 5, '0') || '-of-99999' AS file, true AS signature_ok, count(*) AS records,
  sum(strlen(doc_id::VARCHAR) + 1 + strlen(text))::BIGINT AS decoded_bytes, true AS whole FROM d GROUP BY split, shard""",
    "q71_decoded_messages": f"""SELECT 'zeilé ' || l_orderkey AS name, {_named_sql("l_linenumber", messages.SOURCES)} AS source_name, {_named_sql("l_suppkey % 40", messages.DIFFICULTIES)} AS difficulty_name, l_orderkey, l_partkey, l_linenumber, l_returnflag || ',' || l_linestatus AS tags, 2 AS n_cases, l_suppkey::VARCHAR AS first_input,
  l_linenumber * 40 AS output_length, '' AS second_input, l_returnflag AS second_output, l_linenumber::BIGINT AS code_language, l_partkey::VARCHAR AS code,
  (l_quantity::BIGINT % 5) AS n_incorrect_solutions, l_linenumber + 0.5::DOUBLE AS time_limit_seconds, true AS whole FROM lineitem""",
    "q73_counted_write": data_queries.SQL["q01_gate_funnel"] + f" UNION ALL SELECT 'rejected', count(*)::BIGINT FROM ({data_queries.GATED_SQL}) WHERE len(reject_reasons) > 0",
    "q74_problem_directories": """SELECT 's' || s_suppkey AS pid, s_name AS statement, (s_suppkey * 10)::INTEGER AS difficulty, 'nation,' || s_nationkey AS tags, CASE WHEN s_nationkey > 12 THEN 'float' ELSE 'token' END AS comparison, 256 AS memory_limit_mb,
  3::BIGINT AS n_cases, ((s_nationkey <= 0)::INTEGER + (s_nationkey <= 8)::INTEGER + (s_nationkey <= 16)::INTEGER)::BIGINT AS n_empty, s_name || ' 0' AS first_input FROM supplier""",
    "q75_bundles_apart": """WITH v AS (SELECT 'p' || s_suppkey % 7 AS pid, CASE s_suppkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'natural' WHEN 2 THEN 'injected' ELSE 'ac_invalid' END AS kind, s_name FROM supplier)
SELECT CASE WHEN kind IN ('correct', 'natural') THEN 'public' ELSE 'private' END AS tree, pid, kind, count(*) AS n, count(*) FILTER (kind = 'correct') AS valid, count(*) FILTER (kind IN ('injected', 'ac_invalid')) AS with_error, min(s_name) AS first_code FROM v GROUP BY ALL""",
    "q76_candidate_report": """WITH c AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'injected' WHEN 1 THEN 'ac_invalid' ELSE 'natural' END AS kind, CASE WHEN length(text) > 1500 THEN 'AC' ELSE 'WA' END AS exec_status, 'E' || (1 + doc_id % 8) AS error_type,
  CASE WHEN doc_id % 3 < 2 THEN 'S' || (1 + length(text) % 7) END AS first_error FROM documents),
p AS (SELECT 'kind' AS "column", kind AS value FROM c UNION ALL SELECT 'exec_status', exec_status FROM c UNION ALL SELECT 'error_type', error_type FROM c UNION ALL SELECT 'first_error', first_error FROM c)
SELECT "column", value, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'ac_but_invalid', 'true', count(*) FROM c WHERE kind = 'ac_invalid' AND exec_status = 'AC' UNION ALL SELECT 'injection', 'accepted', count(*) FROM c WHERE kind = 'injected' AND exec_status = 'AC'""",
    "q77_label_impact": """SELECT count(*) FILTER (lang = 'en') AS with_tags, count(*) FILTER (length(text) > 2000) AS with_skill_types, count(*) FILTER (contains(source, 'e')) AS bin_from_labels, count(*) FILTER (contains(text, '?')) AS category_from_labels FROM documents""",
    "q78_verification_split": """WITH l AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT d.doc_id AS cc_id, source AS name, CASE WHEN quality = 1 THEN sha256('code ' || d.doc_id) END AS reference_sha256, CASE WHEN quality = 1 THEN NULL WHEN l.doc_id IS NULL THEN 0 ELSE 2 END AS tried,
  CASE WHEN quality = 1 THEN NULL WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'WA' ELSE 'RE,WA' END AS reasons, CASE WHEN quality = 1 THEN NULL ELSE coalesce(toxic = 1, false) END AS suspected FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id""",
    "q79_shard_listing": f"""WITH {_DEALT}, s AS (SELECT split, shard, row_number() OVER (PARTITION BY split ORDER BY shard) AS n FROM (SELECT DISTINCT split, shard FROM d))
SELECT split, shard, CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1000000 ELSE 2000000 END + n AS ord, 'documents_' || split || '.riegeli-' || lpad(shard::VARCHAR, 5, '0') || '-of-99999' AS file FROM s WHERE split <> 'train' OR n <= 3""",
    "q70_point_lookup": _PLACED + " WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
}
