"""Queries of the scoring side: roll-ups, detection, localisation, fusion, repair, breakdowns, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, external, fusion, gate, metrics, select, validate, verdicts
from ..session import cut
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_returnflag, unnest(list_distinct(string_split(p_type, ' '))) AS tag FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT tag, l_returnflag, count(*) AS n FROM w GROUP BY tag, l_returnflag)
SELECT tag, sum(n)::BIGINT AS n, round(coalesce(sum(n) FILTER (l_returnflag = 'N'), 0) / sum(n), 4) AS pass_rate,
  coalesce(string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) FILTER (l_returnflag <> 'N'), '') AS error_types FROM g GROUP BY tag""")
def q11_tag_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the part's type as tags; return flag N is accepted, others are error types."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.split("p_type", " ")).alias("tags"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("tags", (F.col("l_returnflag") == "N").alias("accepted"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("NONE").alias("error_type"))
    out = metrics.tag_breakdown(rows)
    joined = F.array_join(F.transform(F.map_entries("error_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("tag", "n", "pass_rate", joined.alias("error_types"))


@query("""SELECT coalesce((floor(o_totalprice / 50000) * 50000)::BIGINT || '-' || ((floor(o_totalprice / 50000) * 50000)::BIGINT + 49999), 'unknown') AS bucket, count(*)::BIGINT AS n,
  round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS pass_rate, round(count(*) FILTER (o_orderpriority < '3') / count(*), 4) AS valid_rate,
  round(count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority < '3') / count(*), 4) AS full_correct_rate FROM orders GROUP BY 1""")
def q12_bucket_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").alias("accepted"), (F.col("o_orderpriority") < "3").alias("process_valid"))
    return metrics.difficulty_breakdown(orders, "o_totalprice", 50000)


_VERDICT = "CASE l_returnflag WHEN 'N' THEN 'AC' WHEN 'R' THEN 'WA' ELSE 'TLE' END"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "N", "AC").when(F.col("l_returnflag") == "R", "WA").otherwise("TLE")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))
    # A line number occurs more than once in an order; the worse status of both counts.
    return lines.groupBy("l_orderkey", F.col("l_linenumber").alias("case_index")).agg(F.max("status").alias("status"))


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber AS i, max({_VERDICT}) AS s FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) FILTER (s = 'AC')::BIGINT AS passed, count(*)::BIGINT AS total, coalesce(arg_min(s, i) FILTER (s <> 'AC'), 'AC') AS status,
  min(i) FILTER (s <> 'AC') AS failed_index FROM c GROUP BY l_orderkey""")
def q15_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.first_failure(_cases(spark, sf_dir), ["l_orderkey"], "case_index").drop("n_results")


@query(f"""SELECT l_orderkey, count(*) FILTER (s = 'AC')::BIGINT AS passed, count(*)::BIGINT AS total,
  CASE max(CASE s WHEN 'TLE' THEN 3 WHEN 'RE' THEN 2 WHEN 'WA' THEN 1 ELSE 0 END) WHEN 3 THEN 'TLE' WHEN 2 THEN 'RE' WHEN 1 THEN 'WA' ELSE 'AC' END AS status
FROM (SELECT l_orderkey, {_VERDICT} AS s FROM lineitem) GROUP BY l_orderkey""")
def q16_severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "N", "AC").when(F.col("l_returnflag") == "R", "WA").otherwise("TLE")
    return verdicts.worst(table(spark, sf_dir, "lineitem").select("l_orderkey", status.alias("status")), ["l_orderkey"])


_DETECT = """SELECT d.doc_id, quality = 0 AS bad, len(regexp_extract_all(text, '[!$%&*|]')) * 50 > length(text) AS flag, toxic = 1 AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
_PRF = """tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
  round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0), 4) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 4) AS fpr"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.size(F.regexp_extract_all("text", F.lit("[!$%&*|]"), F.lit(0))) * 50 > F.length("text")).alias("flagged"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("labelled_invalid"), (F.col("toxic") == 1).alias("toxic"))
    return docs.join(labels, "doc_id", "left")


@query(f"""WITH d AS ({_DETECT}),
c AS (SELECT 'strict' AS counting, count(bad)::BIGINT AS n, count(*) FILTER (bad AND flag)::BIGINT AS tp, count(*) FILTER (NOT bad AND flag)::BIGINT AS fp, count(*) FILTER (bad AND NOT flag)::BIGINT AS fn, count(*) FILTER (NOT bad AND NOT flag)::BIGINT AS tn FROM d
  UNION ALL SELECT 'compat', count(bad), count(*) FILTER (bad AND flag), count(*) FILTER (NOT coalesce(bad, false) AND flag), count(*) FILTER (bad AND NOT flag), count(*) FILTER (NOT coalesce(bad, false) AND NOT flag) FROM d)
SELECT counting, n, {_PRF} FROM c""")
def q18_detection_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _detected(spark, sf_dir)
    return metrics.ablation(lambda compat: metrics.detection(rows, compat=compat), {"strict": {"compat": False}, "compat": {"compat": True}}).withColumnRenamed("config", "counting")


@query("""WITH s AS (SELECT user_id, arg_min('S' || (1 + (floor(value)::BIGINT % 7)), event_id) FILTER (event_type = 'error') AS p, arg_min('S' || (1 + (floor(value)::BIGINT % 7)), event_id) FILTER (event_type = 'purchase') AS l FROM events GROUP BY user_id)
SELECT count(l)::BIGINT AS n_steps, round(count(*) FILTER (p = l) / nullif(count(l), 0), 4) AS first_error_exact,
  round(count(*) FILTER (abs(substr(p, 2)::INTEGER - substr(l, 2)::INTEGER) <= 1) / nullif(count(l), 0), 4) AS first_error_within_1 FROM s""")
def q19_first_error_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First error event of each user as the predicted step, first purchase as the labelled one."""
    step = F.concat(F.lit("S"), (1 + F.pmod(F.floor("value").cast("long"), F.lit(7))).cast("string"))
    e = table(spark, sf_dir, "events")
    first = lambda kind: F.min_by(F.when(F.col("event_type") == kind, step), F.when(F.col("event_type") == kind, F.col("event_id")))
    rows = e.groupBy("user_id").agg(first("error").alias("predicted_step"), first("purchase").alias("labelled_step"))
    rows = rows.withColumns({"predicted_type": F.lit("NONE"), "labelled_type": F.lit("NONE")})
    return metrics.localisation(rows).drop("error_type_accuracy")


@query(r"""WITH g AS (SELECT lang AS labelled, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])(the|and)([^A-Za-z0-9_]|$)') THEN 'en' WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])(der|und)([^A-Za-z0-9_]|$)') THEN 'de' WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])(les|des)([^A-Za-z0-9_]|$)') THEN 'fr' ELSE 'es' END AS predicted FROM documents WHERE lang IS NOT NULL),
c AS (SELECT unnest([labelled, predicted]) AS class, labelled = predicted AS hit, unnest(['l', 'p']) AS side FROM g),
s AS (SELECT class, count(*) FILTER (hit AND side = 'l') AS tp, count(*) FILTER (side = 'l') AS support, count(*) FILTER (side = 'p') AS called FROM c GROUP BY class)
SELECT coalesce(round(avg(round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / called) * (tp / support) / (tp / called + tp / support) END, 4)), 4), 0) AS macro_f1 FROM s""")
def q20_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    guess = F.when(t.rlike(r"(^|[^A-Za-z0-9_])(the|and)([^A-Za-z0-9_]|$)"), "en").when(t.rlike(r"(^|[^A-Za-z0-9_])(der|und)([^A-Za-z0-9_]|$)"), "de").when(t.rlike(r"(^|[^A-Za-z0-9_])(les|des)([^A-Za-z0-9_]|$)"), "fr").otherwise("es")
    docs = table(spark, sf_dir, "documents").where("lang is not null").select(F.col("lang").alias("labelled"), guess.alias("predicted"))
    return metrics.macro_f1(docs.groupBy("labelled", "predicted").agg(F.count("*").alias("n")))


@query(f"""WITH d AS ({_DETECT}), c AS (SELECT count(*) FILTER (toxic AND NOT bad AND flag)::BIGINT AS tp, count(*) FILTER (NOT bad AND NOT toxic AND flag)::BIGINT AS fp, count(*) FILTER (toxic AND NOT bad AND NOT flag)::BIGINT AS fn FROM d WHERE bad IS NOT NULL)
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS abi_precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS abi_recall FROM c""")
def q21_abi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good quality but toxic documents as accepted-but-invalid ones."""
    rows = _detected(spark, sf_dir).where("labelled_invalid is not null")
    good = ~F.col("labelled_invalid")
    return metrics.accepted_but_invalid(rows.select((F.col("toxic") & good).alias("abi_label"), "flagged", (~F.col("toxic")).alias("label_valid"), good.alias("label_accepted")))


_ROUNDS = """SELECT user_id, user_id % 3 AS strategy, min(n) FILTER (event_type = 'purchase') AS solved_round, count(*) AS tokens
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) GROUP BY user_id"""


@query(f"""WITH r AS ({_ROUNDS}) SELECT 's' || strategy AS strategy, count(*)::BIGINT AS n, round(count(solved_round) / count(*), 4) AS accepted_rate,
  {", ".join(f"round(count(*) FILTER (solved_round BETWEEN 1 AND {k}) / nullif(count(*) FILTER (solved_round IS NULL OR solved_round > 0), 0), 4) AS refine_at_{k}" for k in (1, 2, 3))},
  {", ".join(f"round(count(*) FILTER (solved_round BETWEEN 1 AND {k}) / count(*), 4) AS refine_all_at_{k}" for k in (1, 2, 3))},
  round(avg(solved_round) FILTER (solved_round > 0), 2) AS mean_rounds, sum(tokens)::BIGINT AS tokens FROM r GROUP BY strategy""")
def q22_refine_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user before the first purchase are attempts; users stand for problems."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    bought = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("first"))
    rows = e.join(bought, "user_id", "left").groupBy("user_id").agg(
        F.when(F.max("first").isNotNull(), F.count_if(F.col("event_id") < F.col("first"))).alias("solved_round"), F.count("*").alias("tokens")
    )
    rows = rows.withColumn("strategy", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")))
    every = rows.groupBy("strategy").agg(*(metrics.refine_at_all("solved_round", k).alias(f"refine_all_at_{k}") for k in (1, 2, 3)))
    return metrics.experiment(rows).join(every, "strategy")


@query(f"""WITH d AS ({_DETECT}) SELECT doc_id, CASE WHEN NOT bad AND NOT flag THEN 'full_correct' WHEN NOT bad AND flag THEN 'ac_but_invalid' WHEN bad AND NOT toxic THEN 'implementation_error' ELSE 'reasoning_error' END AS quadrant FROM d WHERE bad IS NOT NULL""")
def q23_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _detected(spark, sf_dir).where("labelled_invalid is not null")
    return rows.select("doc_id", fusion.quadrant(~F.col("labelled_invalid"), ~F.col("flagged"), F.col("toxic")).alias("quadrant"))


_POS = "(l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey)"
_STEP, _ERROR = "'S' || (1 + l_partkey % 7)", "'E' || (1 + l_suppkey % 8)"
_RULE_SQL = f"SELECT l_orderkey AS c, {_STEP} AS step, {_ERROR} AS err, 4 AS prio, 1 + l_quantity::INTEGER % 5 AS strength, {_POS} AS pos FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_returnflag = 'R'"
_COUNTER_SQL = f"SELECT l_orderkey, {_STEP}, {_ERROR}, 5, CASE WHEN l_tax > 0.04 THEN 5 ELSE 3 END, {_POS} FROM lineitem WHERE l_linenumber % 3 = 0 AND l_linestatus = 'F' AND l_returnflag = 'R'"
_CONSISTENCY_SQL = "SELECT o_orderkey, 'S7', 'E6', 3, CASE WHEN o_orderpriority < '3' THEN 3 ELSE 2 END, 0 FROM orders WHERE o_totalprice >= 300000"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'AC' WHEN 'O' THEN 'WA' ELSE 'TLE' END"
_SANDBOX_SQL = f"SELECT o_orderkey, 'S7', CASE {_STATUS} WHEN 'TLE' THEN 'E5' ELSE 'E7' END, 4, 4, 4611686018427387904 FROM orders WHERE {_STATUS} <> 'AC'"
_SCAN_SQL = """SELECT l_orderkey AS c, 'S' || (1 + l_suppkey % 7) AS step, CASE WHEN max(l_discount) > 0.09 THEN 'incorrect' WHEN max(l_discount) > 0.07 THEN 'suspicious' ELSE 'correct' END AS status,
  (1 + min(l_partkey) % 4) / 4.0::DOUBLE AS conf, 'E' || (1 + min(l_partkey) % 8) AS err FROM lineitem GROUP BY 1, 2"""
_FINE_SQL = """SELECT l_orderkey AS c, 'S' || (1 + l_suppkey % 7) AS step, CASE max(l_partkey) % 3 WHEN 0 THEN 'incorrect' WHEN 1 THEN 'correct' ELSE 'unverifiable' END AS status,
  (1 + max(l_partkey) % 4) / 4.0::DOUBLE AS conf, 'E' || (1 + max(l_suppkey) % 8) AS err FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2"""


def _fuse_sql(rules: bool = True, semantic: bool = True, fine: bool = True, consistency: bool = True, counterexample: bool = True, execution: bool = True) -> str:
    """Decision of each candidate with layers on and off, as a query."""
    nothing = "SELECT 0, '', '', 0, 0, 0 WHERE false"
    layers = [_RULE_SQL + " AND " + str(rules).lower(), *(sql if on else nothing for sql, on in ((_COUNTER_SQL, counterexample), (_CONSISTENCY_SQL, consistency), (_SANDBOX_SQL, execution)))]
    return f"""WITH ev AS ({" UNION ALL ".join(layers)}), scan AS ({_SCAN_SQL}), fine AS (SELECT * FROM ({_FINE_SQL}) WHERE {str(fine).lower()} AND status IN ('correct', 'incorrect') AND conf >= 0.6),
  st AS (SELECT s.c, s.step, coalesce(f.status, s.status) AS status, coalesce(f.conf, s.conf) AS conf, coalesce(f.err, s.err) AS err FROM scan s LEFT JOIN fine f ON s.c = f.c AND s.step = f.step WHERE {str(semantic).lower()}),
  al AS (SELECT c, step, err, 0 AS sem, -prio AS p, -strength AS s, pos, strength, NULL::DOUBLE AS ok FROM ev
         UNION ALL SELECT c, CASE WHEN status = 'incorrect' THEN step END, err, 1, 0, 0, 0, NULL, CASE WHEN status = 'correct' THEN conf END FROM st),
  f AS (SELECT c, arg_min({{'s': step, 'e': err}}, {{'r': substr(step, 2)::INTEGER, 'm': sem, 'p': p, 's': s, 'o': pos}}) FILTER (step IS NOT NULL) AS first, max(strength) AS strength, avg(ok) AS ok FROM al GROUP BY c)
  SELECT o_orderkey AS candidate, {_STATUS if execution else "NULL"} AS exec_status, first IS NULL AS process_valid, first.s AS first_error_step, coalesce(first.e, 'NONE') AS error_type,
    round(least(CASE WHEN strength IS NOT NULL THEN 0.5::DOUBLE + 0.1::DOUBLE * strength ELSE coalesce(ok, 0.5) END, 1.0), 2)::DOUBLE AS confidence FROM orders LEFT JOIN f ON o_orderkey = c"""


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lines of an order as rules, counterexamples and step verdicts about it; its price and status as consistency and execution."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    named = lambda c, n, p: F.concat(F.lit(p), (1 + c % n).cast("string"))
    step, error = named(F.col("l_partkey"), 7, "S"), named(F.col("l_suppkey"), 8, "E")
    pos = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")
    wrong = F.col("l_returnflag") == "R"
    columns = ["candidate", "kind", "strength", "step_id", "error_type", "indicates_invalid", "pos"]
    rule = lines.where("l_linenumber % 3 <> 0").select(F.col("l_orderkey").alias("candidate"), F.lit("rule").alias("kind"), (1 + F.col("l_quantity").cast("int") % 5).alias("strength"), step.alias("step_id"), error.alias("error_type"), wrong.alias("indicates_invalid"), pos.alias("pos"))
    found = fusion.counterexample_evidence(F.col("l_linestatus") == "F", ~wrong, F.col("l_tax") > 0.04, step, error)
    counter = lines.where("l_linenumber % 3 = 0").select(F.col("l_orderkey").alias("candidate"), found.alias("e"), pos.alias("pos")).select("candidate", "e.*", "pos").select(columns)
    clash = fusion.consistency_evidence(F.col("o_totalprice") < 300000, F.col("o_orderpriority") < "3")
    consistency = orders.select(F.col("o_orderkey").alias("candidate"), clash.alias("e"), F.lit(0).cast("long").alias("pos")).where("e is not null").select("candidate", "e.*", "pos").select(columns)
    key = [F.col("l_orderkey").alias("candidate"), named(F.col("l_suppkey"), 7, "S").alias("step_id")]
    sure = lambda c: ((1 + c % 4) / F.lit(4.0)).alias("confidence")
    most, least = F.max("l_discount"), F.min("l_partkey")
    scan = lines.groupBy(*key).agg(F.when(most > 0.09, "incorrect").when(most > 0.07, "suspicious").otherwise("correct").alias("status"), sure(least), named(least, 8, "E").alias("error_type"))
    top = F.max("l_partkey")
    fine = lines.where("l_quantity > 25").groupBy(*key).agg(F.when(top % 3 == 0, "incorrect").when(top % 3 == 1, "correct").otherwise("unverifiable").alias("status"), sure(top), named(F.max("l_suppkey"), 8, "E").alias("error_type"))
    status = F.when(F.col("o_orderstatus") == "F", "AC").when(F.col("o_orderstatus") == "O", "WA").otherwise("TLE")
    return {"structural": rule, "scan": scan, "fine": fine, "consistency": consistency, "counterexample": counter, "executions": orders.select(F.col("o_orderkey").alias("candidate"), status.alias("status"))}


@query(_fuse_sql(fine=False, consistency=False))
def q24_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and step verdicts about each order, and its execution."""
    of = _layers(spark, sf_dir)
    return fusion.fuse(of["structural"].unionByName(of["counterexample"]), of["scan"], of["executions"])


def _in_one_scan(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The evidence and the verdicts of ``_layers`` from one scan of the lines, of which what both need is kept."""
    named = lambda c, n, p: F.concat(F.lit(p), (1 + c % n).cast("string"))
    sure = lambda c: ((1 + c % 4) / F.lit(4.0)).alias("confidence")
    pos = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")
    step, error, wrong = named(F.col("l_partkey"), 7, "S"), named(F.col("l_suppkey"), 8, "E"), F.col("l_returnflag") == "R"
    found = fusion.counterexample_evidence(F.col("l_linestatus") == "F", ~wrong, F.col("l_tax") > 0.04, step, error)
    rule = F.struct(F.lit("rule").alias("kind"), (1 + F.col("l_quantity").cast("int") % 5).alias("strength"), step.alias("step_id"), error.alias("error_type"), wrong.alias("indicates_invalid"))
    is_rule = F.col("l_linenumber") % 3 != 0
    row = F.struct(F.when(is_rule, "rules").otherwise("counterexample").alias("layer"), F.when(is_rule, rule).otherwise(found).alias("e"), pos.alias("pos"))
    fine = F.col("l_quantity") > 25
    most, least, top = F.max("l_discount"), F.min("l_partkey"), F.max(F.when(fine, F.col("l_partkey")))
    scan = F.struct(F.when(most > 0.09, "incorrect").when(most > 0.07, "suspicious").otherwise("correct").alias("status"), sure(least), named(least, 8, "E").alias("error_type"))
    closer = F.struct(F.when(top % 3 == 0, "incorrect").when(top % 3 == 1, "correct").otherwise("unverifiable").alias("status"), sure(top), named(F.max(F.when(fine, F.col("l_suppkey"))), 8, "E").alias("error_type"))
    columns = [F.col("l_orderkey").alias("candidate"), named(F.col("l_suppkey"), 7, "S").alias("verdict_on"), row.alias("r"), *(F.col(c) for c in ("l_discount", "l_partkey", "l_suppkey", "l_quantity"))]
    read = cut(lines.select(*columns))
    grouped = read.groupBy("candidate", F.col("verdict_on").alias("step_id")).agg(scan.alias("scan"), F.when(top.isNotNull(), closer).alias("fine"))
    return read.select("candidate", "r.layer", "r.e.*", "r.pos"), grouped


LAYERS = {"full": {}, "no_rules": {"rules": False}, "no_semantic": {"semantic": False}, "no_fine": {"fine": False}, "no_evidence": {"consistency": False, "counterexample": False}, "no_execution": {"execution": False}}


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS config, count(*)::BIGINT AS n, count(*) FILTER (NOT process_valid)::BIGINT AS invalid, count(*) FILTER (first_error_step = 'S7')::BIGINT AS at_code, count(*) FILTER (error_type = 'E6')::BIGINT AS e6, round(sum(confidence), 1) AS confidence FROM ({_fuse_sql(**off)})"
        for name, off in LAYERS.items()
    )
)
def q50_layered_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers of the evaluation, and what is decided without each."""
    of = _layers(spark, sf_dir)
    evidence, verdicts = _in_one_scan(table(spark, sf_dir, "lineitem"))
    clash = of["consistency"].withColumn("layer", F.lit("consistency"))
    made = fusion.ablate(evidence.unionByName(clash), verdicts, of["executions"], LAYERS)
    at = lambda c, v: F.count_if(F.col(c) == v)
    return made.groupBy("config").agg(F.count("*").alias("n"), F.count_if(~F.col("process_valid")).alias("invalid"), at("first_error_step", "S7").alias("at_code"), at("error_type", "E6").alias("e6"), F.round(F.sum("confidence"), 1).alias("confidence"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 OR o_orderstatus = 'P' OR o_totalprice >= 300000 OR o_orderpriority LIKE '1%' THEN 'HIGH' ELSE 'LOW' END AS budget FROM orders""")
def q25_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("o_orderpriority").startswith("1"), "solve").otherwise("verify")
    repairs = F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)
    made = fusion.budget(repairs, F.col("o_orderstatus") == "P", F.lit(False), F.col("o_totalprice"), phase, 300000)
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("budget"))


#: Switches of the rule that flags documents, one set for each configuration.
CONFIGS = {
    "full": {"symbols": True, "shouting": True, "short": True}, "no_symbols": {"symbols": False, "shouting": True, "short": True}, "no_shouting": {"symbols": True, "shouting": False, "short": True},
    "no_short": {"symbols": True, "shouting": True, "short": False}, "symbols_only": {"symbols": True, "shouting": False, "short": False}, "none": {"symbols": False, "shouting": False, "short": False},
}
_RULES = {"symbols": "len(regexp_extract_all(text, '[!$%&*|]')) * 50 > length(text)", "shouting": r"regexp_matches(text, '(^|[^A-Za-z0-9_])[A-Z]{6,}([^A-Za-z0-9_]|$)')", "short": "length(text) < 100"}


@query(
    "WITH c AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS config, count(bad)::BIGINT AS n, count(*) FILTER (bad AND flag)::BIGINT AS tp, count(*) FILTER (NOT bad AND flag)::BIGINT AS fp, count(*) FILTER (bad AND NOT flag)::BIGINT AS fn, count(*) FILTER (NOT bad AND NOT flag)::BIGINT AS tn "
        f"FROM (SELECT quality = 0 AS bad, {' OR '.join(f'({_RULES[k]})' for k, on in switches.items() if on) or 'false'} AS flag FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
        for name, switches in CONFIGS.items()
    )
    + f") SELECT config, n, {_PRF} FROM c"
)
def q36_ablation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.size(F.regexp_extract_all("text", F.lit("[!$%&*|]"), F.lit(0))) * 50 > F.length(t)).alias("symbols"), t.rlike("(^|[^A-Za-z0-9_])[A-Z]{6,}([^A-Za-z0-9_]|$)").alias("shouting"), (F.length(t) < 100).alias("short")
    )
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("labelled_invalid")), "doc_id")
    flag = lambda on: F.array_contains(F.array(F.lit(False), *(F.col(name) for name, wanted in on.items() if wanted)), True)
    each = F.array(*(F.struct(F.lit(name).alias("config"), flag(on).alias("flagged")) for name, on in CONFIGS.items()))
    return metrics.detection(rows.select("labelled_invalid", F.explode(each).alias("c")).select("labelled_invalid", "c.*"), "config")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE l.quality WHEN 1 THEN 'good' ELSE 'bad' END WHEN d.source IN ('src0', 'src1') THEN 'trusted' END AS kind, l.doc_id IS NOT NULL AND l.quality = 0 AND l.toxic = 1 AS flagged
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q37_label_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline labels of two sources, overlaid by the label table where it has a row."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    own = F.when(F.col("source").isin("src0", "src1"), F.create_map(F.lit("kind"), F.lit("trusted")))
    external = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("kind"), F.when(F.col("quality") == 1, "good").otherwise("bad")))
    both = validate.overlay(own, external)
    flagged = F.coalesce((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(False))
    return docs.join(labels, "doc_id", "left").select("doc_id", F.try_element_at(both, F.lit("kind")).alias("kind"), flagged.alias("flagged"))


@query("""SELECT o_orderpriority, count(*)::BIGINT AS n, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS pass_at_1, round(count(*) FILTER (o_totalprice < 200000) / count(*), 4) AS process_valid_rate,
  round(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice < 200000) / count(*), 4) AS dual_correct_rate FROM orders GROUP BY o_orderpriority""")
def q51_solver_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("accepted"), (F.col("o_totalprice") < 200000).alias("process_valid"))
    return metrics.solver_rates(rows, "o_orderpriority")


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_size < 30 THEN 'token' WHEN p_size < 45 THEN 'float' ELSE 'exact' END AS mode FROM part)
SELECT v AS mode, (SELECT count(*) FROM m WHERE mode = v)::BIGINT AS n, NULL::BIGINT AS p_partkey FROM (VALUES ('token'), ('exact'), ('float'), ('special')) AS t(v) UNION ALL SELECT mode, NULL, p_partkey FROM m WHERE mode <> 'token'""")
def q52_mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all modes, and the parts that are not of the default one."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 30, "token").when(F.col("p_size") < 45, "float").otherwise("exact").alias("mode"))
    return metrics.zero_filled(rows, "mode", ("token", "exact", "float", "special")).unionByName(metrics.other_than(rows, "mode", "token", "p_partkey"), allowMissingColumns=True)


@query("""SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*)::BIGINT AS n FROM customer GROUP BY ALL UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY ALL""")
def q53_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS i, max({_VERDICT}) AS s, max(l_quantity)::INTEGER AS t FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey, count(*) AS total, min(i) FILTER (s <> 'AC') AS first, bool_or(s <> 'AC') FILTER (i < 3) AS probe FROM c GROUP BY l_orderkey),
r AS (SELECT c.*, total, row_number() OVER (PARTITION BY l_orderkey, s <> 'AC' ORDER BY i) AS n FROM c JOIN f USING (l_orderkey) WHERE first IS NULL OR i <= CASE WHEN probe THEN 2 ELSE first END)
SELECT l_orderkey, any_value(total)::BIGINT AS cases_total, count(*)::BIGINT AS cases_run, count(*) FILTER (s = 'AC')::BIGINT AS cases_passed, max(t) AS max_ms, sum(t)::BIGINT AS total_ms, (any_value(total) - count(*))::BIGINT AS skipped,
  coalesce(arg_min(s, i) FILTER (s <> 'AC'), 'AC') AS verdict, count(*) FILTER (s <> 'AC') = 0 AS ok, coalesce(string_agg(i || s, ',' ORDER BY i) FILTER (s <> 'AC' AND n <= 2), '') AS failures FROM r GROUP BY l_orderkey""")
def q54_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as cases; the first three are the probe."""
    status = F.when(F.col("l_returnflag") == "N", "AC").when(F.col("l_returnflag") == "R", "WA").otherwise("TLE")
    cases = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("i")).agg(F.max(status).alias("status"), F.max("l_quantity").cast("int").alias("time_ms"))
    out = verdicts.two_stage(cases, ["l_orderkey"], "i", 3, 2)
    return out.withColumn("failures", F.array_join(F.transform("failures", lambda f: F.concat(f["index"].cast("string"), f["verdict"])), ","))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY length(o_orderpriority), o_orderkey) - 1 AS attempt FROM orders)
SELECT o_custkey, arg_min(o_orderkey, attempt) AS o_orderkey, min(attempt)::INTEGER AS attempt FROM a WHERE attempt < 3 AND o_orderstatus = 'F' GROUP BY o_custkey""")
def q55_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest three solutions of each customer, and the first of them that is accepted."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    tried = select.shortest_first(rows, "o_custkey", "o_orderpriority", "o_orderkey", 3)
    return select.first_success(tried, "o_custkey", F.col("o_orderstatus") == "F", "attempt", "o_orderkey", "attempt")


@query("""WITH c AS (SELECT conv_id AS pid, CASE role WHEN 'user' THEN 'public' WHEN 'assistant' THEN 'private' ELSE 'generated' END AS origin, turn AS ord, text AS input, role AS output FROM conversations WHERE strlen(text) <= 2000),
l AS (SELECT *, CASE origin WHEN 'public' THEN 0 ELSE 1 END AS rank, CASE origin WHEN 'public' THEN '' ELSE md5(concat_ws(chr(31), '42', pid, origin, ord)) END AS lot FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY pid, input || chr(30) || output ORDER BY rank, lot, ord) AS seen FROM l),
p AS (SELECT pid, origin, ord, row_number() OVER (PARTITION BY pid ORDER BY rank, lot, ord) - 1 AS position FROM s WHERE origin = 'public' OR seen = 1)
SELECT pid, origin, ord, position::INTEGER AS position FROM p WHERE position < 5""")
def q56_case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cases: what users say is public, the rest is drawn by hash."""
    origin = F.when(F.col("role") == "user", "public").when(F.col("role") == "assistant", "private").otherwise("generated")
    cases = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pid"), origin.alias("origin"), F.col("turn").alias("ord"), F.col("text").alias("input"), F.col("role").alias("output"))
    return select.select_cases(cases, 5, 2000).select("pid", "origin", "ord", "position")


@query("""WITH f AS (SELECT l_orderkey, l_suppkey % 2 AS attempt, CASE WHEN max(l_quantity) < 48 THEN 'WA' ELSE 'TLE' END AS verdict,
  bool_and(l_quantity < 45) AS all_wrong, bool_and(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END = CASE WHEN l_partkey % 3 = 0 THEN 2 WHEN l_partkey % 3 = 1 THEN 1 ELSE 0 END) AS all_same,
  bool_or(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END = CASE WHEN l_partkey % 3 = 0 THEN 2 WHEN l_partkey % 3 = 1 THEN 1 ELSE 0 END) AS any_same FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, count(*) FILTER (verdict = 'WA' AND all_wrong AND all_same)::BIGINT AS retries, bool_and(verdict = 'WA') AND bool_or(any_same) AS suspected FROM f GROUP BY l_orderkey""")
def q57_retry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as failures of two attempts at an order: which attempts to try with number tolerance, which orders to look at."""
    got = F.when(F.col("l_linenumber") % 2 == 0, " 1  2").otherwise("1")
    want = F.when(F.col("l_partkey") % 3 == 0, "3 4").when(F.col("l_partkey") % 3 == 1, "3").otherwise("")
    failure = F.struct(F.when(F.col("l_quantity") < 45, "WA").otherwise("TLE").alias("verdict"), got.alias("stdout_head"), want.alias("expected_head"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 2).alias("attempt"), "l_quantity", failure.alias("failure"))
    tried = lines.groupBy("l_orderkey", "attempt").agg(F.when(F.max("l_quantity") < 48, "WA").otherwise("TLE").alias("verdict"), F.collect_list("failure").alias("failures"))
    return tried.groupBy("l_orderkey").agg(F.count_if(gate.needs_number_tolerance("verdict", "failures")).alias("retries"), F.collect_list(F.struct("verdict", "failures")).alias("attempts")).select(
        "l_orderkey", "retries", gate.special_judge_suspected("attempts").alias("suspected")
    )


@query("""SELECT user_id, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(event_id % 7)::BIGINT AS completion_tokens, sum(event_id % 100 + event_id % 7)::BIGINT AS total_tokens, count(*)::BIGINT AS calls FROM events GROUP BY user_id""")
def q58_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"))
    return verdicts.usage(calls, "user_id")


@query("SELECT count(*) FILTER (c_acctbal > 0)::BIGINT AS before, count(*) FILTER (c_acctbal > 0 OR c_mktsegment <> 'BUILDING')::BIGINT AS after FROM customer")
def q59_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a value before and after another column fills gaps."""
    first = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string"))
    rows = table(spark, sf_dir, "customer").select(first.alias("v"), F.coalesce(first, F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))).alias("w"))
    return enrich.coverage(rows.select("v"), rows.select(F.col("w").alias("v")), "v")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, 'S' || (1 + l_suppkey % 8) AS step_id, CASE l_returnflag WHEN 'N' THEN 'correct' WHEN 'R' THEN 'incorrect' ELSE 'bad' END AS status, l_quantity::INTEGER % 7 AS strength FROM lineitem),
b AS (SELECT *, concat_ws(',', CASE WHEN step_id = 'S8' THEN 'step_id' END, CASE WHEN status = 'bad' THEN 'status' END, CASE WHEN strength NOT BETWEEN 1 AND 5 THEN 'strength' END) AS broken FROM r)
SELECT broken, count(*)::BIGINT AS n FROM b GROUP BY broken""")
def q60_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "N", "correct").when(F.col("l_returnflag") == "R", "incorrect").otherwise("bad")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), (1 + F.col("l_suppkey") % 8).cast("string")).alias("step_id"), status.alias("status"), (F.col("l_quantity").cast("int") % 7).alias("strength"))
    good, bad = validate.quarantined(rows, validate.domain_checks())
    return good.withColumn("broken", F.array().cast("array<string>")).unionByName(bad).groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT o_orderkey AS candidate, 'S' || s AS step_id FROM orders, range(1, 8) t(s)), v AS ({_SCAN_SQL})
SELECT candidate, step_id, coalesce(status, 'unverifiable') AS status, coalesce(conf, 0.0) AS confidence, coalesce(err, 'NONE') AS error_type FROM c LEFT JOIN v ON candidate = v.c AND step_id = step""")
def q61_padded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = _layers(spark, sf_dir)
    return validate.padded_steps(of["scan"], of["executions"])


@query(f"""WITH s AS ({_SCAN_SQL}), f AS ({_FINE_SQL})
SELECT s.c AS candidate, s.step AS step_id, CASE WHEN u THEN f_status ELSE status END AS status, CASE WHEN u THEN f_conf ELSE conf END AS confidence, CASE WHEN u THEN f_err ELSE err END AS error_type
FROM (SELECT s.*, f.status AS f_status, f.conf AS f_conf, f.err AS f_err, coalesce(f.status IN ('correct', 'incorrect') AND f.conf >= 0.6, false) AS u FROM s LEFT JOIN f ON s.c = f.c AND s.step = f.step) s""")
def q62_merged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = _layers(spark, sf_dir)
    return fusion.merged_verdicts(of["scan"], of["fine"])


_VARIANT_SQL = """SELECT o_custkey // 3 AS pid, o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'correct' ELSE 'v' || o_orderkey END AS name, CASE o_custkey % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'injected' ELSE 'ac_invalid' END AS kind,
  CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS s1, o_orderstatus AS s2, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'c' END AS s3, o_orderpriority AS code, CASE WHEN o_orderkey % 4 = 0 THEN 'S1' ELSE 'S2' END AS first_error FROM orders"""


@query(f"""WITH v AS ({_VARIANT_SQL}), b AS (SELECT pid, arg_min({{'s1': s1, 's2': s2, 's3': s3, 'code': code}}, o_orderkey) AS base FROM v WHERE name = 'correct' GROUP BY pid),
d AS (SELECT v.pid, name, kind, first_error, code IS DISTINCT FROM base.code AS recoded, list_filter([CASE WHEN s1 IS DISTINCT FROM base.s1 THEN 'S1' END, CASE WHEN s2 IS DISTINCT FROM base.s2 THEN 'S2' END, CASE WHEN s3 IS DISTINCT FROM base.s3 THEN 'S3' END], lambda x: x IS NOT NULL) AS diff FROM v JOIN b ON v.pid = b.pid WHERE kind <> 'correct')
SELECT pid, name, unnest(list_filter([CASE WHEN len(diff) = 0 THEN 'nothing_changed' END, CASE WHEN diff[1] < first_error THEN 'prefix_changed' END, CASE WHEN diff[1] > first_error THEN 'label_not_changed' END,
  CASE WHEN kind = 'ac_invalid' AND len(diff) <> 1 THEN 'more_than_one_changed' END, CASE WHEN kind = 'ac_invalid' AND recoded THEN 'code_changed' END], lambda x: x IS NOT NULL)) AS violation FROM d""")
def q63_against_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every third customer as the correct answer, the others' as changed ones."""
    kind = F.when(F.col("o_custkey") % 3 == 0, "correct").when(F.col("o_custkey") % 3 == 1, "injected").otherwise("ac_invalid")
    name = F.when(F.col("o_custkey") % 3 == 0, "correct").otherwise(F.concat(F.lit("v"), F.col("o_orderkey").cast("string")))
    steps = F.map_filter(F.create_map(F.lit("S1"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b"), F.lit("S2"), F.col("o_orderstatus"), F.lit("S3"), F.when(F.col("o_orderkey") % 5 != 0, "c")), lambda _, v: v.isNotNull())
    rows = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / 3).alias("pid"), name.alias("name"), "o_orderkey", kind.alias("kind"), steps.alias("steps"), F.col("o_orderpriority").alias("code"), F.when(F.col("o_orderkey") % 4 == 0, "S1").otherwise("S2").alias("first_error")
    )
    first = select.first_success(rows.where("kind = 'correct'"), "pid", F.lit(True), "o_orderkey", "name", "kind", "steps", "code", "first_error")
    return validate.against_base(rows.where("kind <> 'correct'").drop("o_orderkey").unionByName(first))


@query("""SELECT p_partkey, list_filter([p_brand, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type], lambda x: length(x) > 5)[1] AS first FROM part""")
def q64_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.array("p_brand"), F.split("p_name", " "), F.array("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", select.first_match(words, lambda w: F.length(w) > 5).alias("first"))


@query("""WITH c AS (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS passed, count(o_orderkey) AS total, arg_min(CASE WHEN o_totalprice > 300000 THEN 'TLE' WHEN o_totalprice > 250000 THEN 'MLE' WHEN o_orderkey % 10 = 0 THEN 'RE' ELSE 'WA' END, o_orderkey) FILTER (o_orderstatus <> 'F') AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT c_custkey, passed::BIGINT AS passed, total::BIGINT AS total, CASE WHEN total = 0 THEN 'SE' ELSE coalesce(status, 'AC') END AS status FROM c""")
def q65_case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of a customer's program: time before memory before exit code before the comparison; no case is a system error."""
    orders = table(spark, sf_dir, "orders")
    passed = F.col("o_orderstatus") == "F"
    status = F.when(passed, "AC").otherwise(verdicts.case_status(F.col("o_totalprice") > 300000, F.col("o_totalprice") > 250000, F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0), F.lit(False)))
    rolled = verdicts.first_failure(orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", status.alias("status")), ["c_custkey"], "o_orderkey")
    return verdicts.without_cases(table(spark, sf_dir, "customer").select("c_custkey"), rolled, ["c_custkey"]).select("c_custkey", "passed", "total", "status")


@query("""SELECT p_partkey, 'Solve {x} ' || p_name || ' as {"k": ' || p_size || '}' AS prompt, CASE WHEN contains(p_name, 'red') THEN 'r' WHEN contains(p_name, 'gear') OR contains(p_name, 'rod') THEN 'g' END AS reply,
  length('Solve {x} ' || p_name || ' as {"k": ' || p_size || '}')::INTEGER AS prompt_tokens, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'gear') OR contains(p_name, 'rod') THEN 1 ELSE 0 END AS completion_tokens FROM part""")
def q66_scripted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame([("gear", "g", 2), ("red", "r", 1), ("rod", "g", 3)], "keyword string, reply string, ord int")
    made = external.prompt('Solve {x} {name} as {"k": {size}}', name="p_name", size=F.col("p_size").cast("string"))
    return external.scripted(table(spark, sf_dir, "part").select("p_partkey", made.alias("prompt")), routes)
