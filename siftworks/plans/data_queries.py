"""Queries of the data-set side: gates, keys, enrichment, bins, categories, selection, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, compare, tags, text
from ..operators import enrich, fusion, gate, sample, select, validate
from ..sources import messages
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Word boundaries are written out, as engines differ in whether a letter beyond ASCII makes one.
SHOUTING = "(^|[^A-Za-z0-9_])[A-Z]{6,}([^A-Za-z0-9_]|$)"
SIGNALS = (("has_digit", "[0-9]"), ("shouting", SHOUTING), ("piped", r"\|"), ("licence", "(^|[^A-Za-z0-9_])[Ll][Ii][Cc][Ee][Nn][Ss][Ee]"))

GATED_SQL = rf"""
  SELECT doc_id, lang, source,
         list_filter([CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang_excluded' END, CASE WHEN strlen(text) > 8000 THEN 'too_large' END,
                      CASE WHEN length(text) < 200 THEN 'too_short' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'has_digit' END,
                      CASE WHEN regexp_matches(text, '{SHOUTING}') THEN 'shouting' END], lambda x: x IS NOT NULL) AS reject_reasons
  FROM documents"""


def gated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    found = gate.reasons(
        ("lang_excluded", ~F.col("lang").isin("en", "de", "fr")),
        ("too_large", text.byte_length("text") > 8000),
        ("too_short", F.length("text") < 200),
        *((name, F.array_contains(tags.matching("text", (SIGNALS[i],)), name)) for i, name in enumerate(("has_digit", "shouting"))),
    )
    return docs.select("doc_id", "lang", "source", found.alias("reject_reasons")).withColumn("passed", F.size("reject_reasons") == 0)


@query(f"""WITH g AS ({GATED_SQL})
SELECT metric, count(*)::BIGINT AS n FROM (
  SELECT 'records' AS metric FROM g UNION ALL SELECT 'passed' FROM g WHERE len(reject_reasons) = 0
  UNION ALL SELECT 'reason:' || unnest(reject_reasons) FROM g) GROUP BY metric""")
def q01_gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.funnel(gated_documents(spark, sf_dir))


@query(f"WITH g AS ({GATED_SQL}) SELECT source, lang, count(*)::BIGINT AS n FROM g WHERE len(reject_reasons) = 0 GROUP BY source, lang")
def q02_passed_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.passed_by(gated_documents(spark, sf_dir), "source", "lang")


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{name}' END" for name, p in SIGNALS) + "], lambda x: x IS NOT NULL), ',') AS signals FROM documents")
def q03_signal_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags.matching("text", SIGNALS), ",").alias("signals"))


@query("""SELECT conv_id, count(*) FILTER (strlen(text) <= 300 AND strlen(role) <= 6)::INTEGER AS n_retainable, count(*) FILTER (strlen(text) <= 300 AND strlen(role) <= 300)::BIGINT AS n_fit, sum(strlen(text) + strlen(role))::BIGINT AS n_bytes, sum(strlen(text))::BIGINT AS text_bytes
FROM (SELECT conv_id, text, CASE WHEN role = 'assistant' THEN 'assistant, long' ELSE role END AS role FROM conversations) GROUP BY conv_id""")
def q04_retainable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cases; a group is one conversation."""
    said = F.when(F.col("role") == "assistant", "assistant, long").otherwise(F.col("role"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("input"), said.alias("output"))
    held = turns.groupBy("conv_id").agg(
        F.collect_list(F.struct("input", "output")).alias("cases"), F.count_if(text.fits("input", "output", 300)).alias("n_fit"), F.sum(text.byte_length("input")).alias("text_bytes"), F.max(F.octet_length("output")).alias("_most")
    )
    small = F.filter("cases", lambda c: F.octet_length(c["output"]) <= 6)
    return held.select("conv_id", gate.retainable(small, 300).alias("n_retainable"), "n_fit", text.case_bytes("cases", "input", "output").alias("n_bytes"), "text_bytes")


_PAGE_KEY = r"""CASE WHEN regexp_matches(url, '^https?://m\.') THEN concat_ws(':', 'mobile', regexp_extract(url, '^https?://m\.([^/]+)/([a-z]{2})/([0-9]+)', 1), regexp_extract(url, '^https?://m\.([^/]+)/([a-z]{2})/([0-9]+)', 3))
  WHEN regexp_matches(url, '^https?://([^/]+)/([a-z]{2})/([0-9]+)') THEN concat_ws(':', 'desktop', regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/([0-9]+)', 1), regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/([0-9]+)', 3)) END"""


def _page_key():
    mobile, desktop = r"^https?://m\.([^/]+)/([a-z]{2})/([0-9]+)", r"^https?://([^/]+)/([a-z]{2})/([0-9]+)"
    part = lambda p, i: F.regexp_extract("url", p, i)
    return F.when(F.col("url").rlike(r"^https?://m\."), F.concat_ws(":", F.lit("mobile"), part(mobile, 1), part(mobile, 3))).when(
        F.col("url").rlike(desktop), F.concat_ws(":", F.lit("desktop"), part(desktop, 1), part(desktop, 3))
    )


@query(f"SELECT page_id, {_PAGE_KEY} AS page_key FROM pages")
def q05_url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", _page_key().alias("page_key"))


@query(f"""WITH k AS (SELECT page_id, split_part({_PAGE_KEY}, ':', 2) AS host FROM pages)
SELECT host, page_id FROM (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM k WHERE host IS NOT NULL) WHERE n = 1""")
def q06_first_wins_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "pages").select("page_id", F.get(F.split(_page_key(), ":"), F.lit(1)).alias("host"))
    return enrich.first_wins(keyed, "host", "page_id").select("host", "page_id")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed FROM customer),
s AS (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 7000 GROUP BY s_nationkey),
m AS (SELECT o_orderkey, CASE WHEN c.listed THEN 'key' WHEN s.s_suppkey IS NOT NULL THEN 'title' ELSE 'none' END AS taco_match
      FROM orders LEFT JOIN c ON o_custkey = c_custkey LEFT JOIN s ON c_nationkey = s_nationkey)
SELECT taco_match, count(*)::BIGINT AS n FROM m GROUP BY taco_match""")
def q07_match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to the listed customers by key, else to the first supplier of the customer's nation, if the index has that nation."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    listed = customers.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.concat(F.lit("c"), "c_custkey").alias("taco_key"), F.lit("").alias("title"), F.col("c_custkey").alias("ref"), F.col("c_custkey").alias("ord"))
    nations = table(spark, sf_dir, "supplier").where("s_acctbal > 7000").select(F.lit(None).cast("string").alias("taco_key"), F.concat(F.lit("n"), "s_nationkey").alias("title"), F.col("s_suppkey").alias("ref"), F.col("s_suppkey").alias("ord"))
    key, titles = F.concat(F.lit("c"), "o_custkey"), F.array(F.concat(F.lit("n"), "c_nationkey"))
    rows = orders.select("o_orderkey", "o_custkey", "c_nationkey")
    return enrich.match_counts(enrich.cascade(rows, "o_orderkey", key, titles, listed.unionByName(nations), ["ref"], "ord"))


_BINS = """SELECT p_partkey, CASE WHEN r BETWEEN 1 AND 999 THEN 'low' WHEN r BETWEEN 1000 AND 1499 THEN 'mid' WHEN p_size BETWEEN 1 AND 15 THEN 'low' WHEN p_size BETWEEN 16 AND 35 THEN 'mid' ELSE 'high' END AS bin, p_brand
  FROM (SELECT *, floor((p_retailprice - 900) * 25)::BIGINT AS r FROM part)"""


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_price = classify.rated_bin(F.floor((F.col("p_retailprice") - 900) * 25), ((0, 1000, "low"), (1000, 1500, "mid")))
    by_size = F.when(F.col("p_size").between(1, 15), "low").when(F.col("p_size").between(16, 35), "mid").otherwise("high")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(by_price, by_size).alias("bin"), "p_brand")


@query("""WITH r AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS running_size,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, running_size FROM r WHERE n <= 3 AND running_size <= 80""")
def q13_bounded_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    kept = select.bounded_prefix(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_quantity"), 3, 80)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "running_size")


@query("""SELECT role, text, conv_id, turn FROM (SELECT role, text, conv_id, turn, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1""")
def q14_ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("role", "text", "conv_id", "turn")
    return select.ordered_distinct(turns, ["role", "text"], ["conv_id", "turn"])


@query("""WITH p AS (SELECT p_partkey, printf('%.2f', p_retailprice) AS a, printf('%.7f', p_retailprice + CASE WHEN p_partkey % 5 = 0 THEN 0.01 ELSE 0.0000001 END) || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END AS b FROM part)
SELECT p_partkey, trim(a) = trim(b) AS as_lines, string_split(trim(a), ' ') = string_split(trim(b), ' ') AS as_tokens,
  a = trim(b) OR abs(a::DOUBLE - trim(b)::DOUBLE) <= greatest(1e-6, 1e-6 * abs(trim(b)::DOUBLE)) AS as_numbers FROM p""")
def q17_compare_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.when(F.col("p_partkey") % 5 == 0, F.lit(0.01)).otherwise(F.lit(0.0000001))
    b = F.concat(F.format_string("%.7f", F.col("p_retailprice") + shift), F.when(F.col("p_partkey") % 2 == 0, F.lit(" ")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.format_string("%.2f", "p_retailprice").alias("a"), b.alias("b"))
    modes = {"as_lines": "exact", "as_tokens": "token", "as_numbers": "float"}
    return rows.select("p_partkey", *(compare.outputs_equal("a", "b", m).alias(n) for n, m in modes.items()))


@query("""SELECT conv_id, sha256(string_agg(role || chr(30) || text || chr(29), '' ORDER BY turn, role, text)) AS digest, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id""")
def q26_ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group is one conversation, so a list has a conversation's turns."""
    turns = table(spark, sf_dir, "conversations")
    cases = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(text.ordered_digest(cases, "role", "text").alias("digest"), F.count("*").alias("n"))


_TURN_STEPS = ", ".join(f"string_agg(text, chr(30) ORDER BY turn, text) FILTER (least(turn, 6) = {i}) AS s{i + 1}" for i in range(7))
_TURN_CHANGES = ", ".join(f"CASE WHEN v.s{i} IS DISTINCT FROM b.s{i} THEN 'S{i}' END" for i in range(1, 8))


@query(f"""WITH v AS (SELECT conv_id, {_TURN_STEPS} FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id // 4 AS pid, * FROM v WHERE conv_id % 4 = 0)
SELECT v.conv_id, concat_ws(',', {_TURN_CHANGES}) AS changed FROM v JOIN b ON v.conv_id // 4 = b.pid WHERE v.conv_id % 4 <> 0""")
def q27_self_join_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against the first of its block of four, all turns as steps S1 to S7; the last step has all turns from the seventh on."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    number = F.least(F.col("turn"), F.lit(6)) + 1
    said = turns.groupBy("conv_id", F.concat(F.lit("S"), number.cast("string")).alias("step")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("said"))
    said = said.withColumn("text", F.array_join(F.transform("said", lambda t: t["text"]), "\x1e"))
    steps = said.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "text"))).alias("steps"))
    base = steps.where("conv_id % 4 = 0").select(F.floor(F.col("conv_id") / 4).alias("pid"), F.col("steps").alias("base"))
    rows = steps.where("conv_id % 4 <> 0").withColumn("pid", F.floor(F.col("conv_id") / 4)).join(base, "pid")
    return rows.select("conv_id", F.array_join(validate.changed_steps(F.col("base"), F.col("steps")), ",").alias("changed"))


@query("""SELECT p_partkey, p_name, 'stale' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45 AND l_partkey IS NOT NULL)
UNION ALL SELECT p_partkey, NULL, 'missing' FROM (SELECT DISTINCT p_partkey + 7 AS p_partkey FROM part) WHERE p_partkey NOT IN (SELECT p_partkey FROM part)""")
def q28_stale_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large line keeps, and wanted parts that there are none of."""
    keep = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    wanted = parts.select((F.col("p_partkey") + 7).alias("p_partkey")).distinct()
    left = validate.stale(parts, keep, "p_partkey").withColumn("side", F.lit("stale"))
    return left.unionByName(validate.missing(wanted, parts, "p_partkey").select("p_partkey", F.lit(None).cast("string").alias("p_name"), F.lit("missing").alias("side")))


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_partkey, i::BIGINT AS row_index, 'E' || ((i * 2) % 8 + 1) || ',' || 'E' || ((i * 2 + 1) % 8 + 1) AS assigned FROM r""")
def q29_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey")
    planned = select.round_robin(parts, ["p_partkey"], 2, [f"E{i}" for i in range(1, 9)])
    return planned.select("p_partkey", "row_index", F.array_join("assigned", ",").alias("assigned"))


@query("""SELECT DISTINCT l_orderkey, (l_linenumber - 1 + d)::INTEGER AS step FROM lineitem, (VALUES (-1), (0), (1)) AS t(d)
WHERE l_returnflag = 'R' AND l_linenumber BETWEEN 1 AND 7 AND l_linenumber - 1 + d BETWEEN 0 AND 6""")
def q30_band_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_linenumber") - 1).alias("step"))
    return fusion.neighbours(rows, "l_orderkey", "step")


@query("""WITH i AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END AS split, o_orderkey % 100 AS shard, o_custkey AS record_index FROM orders)
SELECT o_orderkey, printf('cc-%s-%03d-%04d', split, shard, record_index) AS cc_id, shard FROM i
WHERE (split, shard, record_index) IN (SELECT CASE WHEN c_acctbal > 4000 THEN 'train' ELSE 'test' END, c_nationkey * 4, c_custkey FROM customer)""")
def q31_semi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose encoded id is in a table of wanted ids: split, shard and record of each customer."""
    split = F.when(F.col("o_orderstatus") == "F", "train").otherwise("test")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.composite_id(split, F.col("o_orderkey") % 100, F.col("o_custkey")).alias("cc_id"))
    rows = rows.withColumn("parts", text.id_parts("cc_id")).select("o_orderkey", "cc_id", "parts.*")
    wanted = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 4000, "train").otherwise("test").alias("split"), (F.col("c_nationkey") * 4).alias("shard"), F.col("c_custkey").cast("int").alias("record_index"))
    return rows.join(wanted, ["split", "shard", "record_index"], "left_semi").select("o_orderkey", "cc_id", F.col("shard").cast("long").alias("shard"))


@query("""WITH f AS (SELECT unnest(CASE WHEN event_type = 'error' THEN [1] WHEN user_id % 2 = 0 THEN [1, 2, 2] ELSE [1, 3] END) AS number FROM events)
SELECT number, count(*)::BIGINT AS n, CASE number WHEN 1 THEN '0' WHEN 2 THEN '2' ELSE '5' END AS wire_types FROM f GROUP BY number""")
def q32_field_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a varint, of strings and of a 32-bit number; the fields are found in the bytes."""
    kind = F.when(F.col("event_type") == "error", "").when(F.col("user_id") % 2 == 0, "1203616263120100").otherwise("1d01020304")
    small = F.lpad(F.hex(F.pmod("event_id", F.lit(128))), 2, "0")
    raw = table(spark, sf_dir, "events").select(F.unhex(F.concat(F.lit("08"), small, kind)).alias("raw"))
    found = messages.field_histogram(raw)
    return found.select("number", "n", F.array_join(F.transform("wire_types", lambda w: w.cast("string")), ",").alias("wire_types"))


_STEP_SQL = [f"CASE WHEN doc_id % 7 = {i} THEN ' short ' WHEN doc_id % 9 = {i} THEN NULL ELSE 'a step of enough letters' END" for i in range(7)]
_STEP_SQL[4] = "CASE doc_id % 5 WHEN 0 THEN 'it takes O(n log n) steps' WHEN 1 THEN 'it takes O (n) steps' WHEN 2 THEN 'it takes a long time' WHEN 3 THEN ' ' END"
_STEP_SQL[2] = "CASE doc_id % 4 WHEN 0 THEN 'we Sort the numbers first' ELSE 'we count the numbers twice' END"
_CODE_SQL = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'short' ELSE 'for i in x: while j: ' || text END"
_SHORT = ", ".join(f"CASE WHEN length(coalesce(trim(s{i}), '')) < 10 THEN 'S{i}:{e}:4:true' END" for i, e in enumerate(("E1", "E8", "E2", "E3", "E5", "E4", "E7"), 1))


@query(rf"""WITH d AS (SELECT doc_id, lang, {", ".join(f"{x} AS s{i}" for i, x in enumerate(_STEP_SQL, 1))}, {_CODE_SQL} AS code FROM documents),
x AS (SELECT doc_id, unnest(list_filter([{_SHORT}, CASE WHEN coalesce(trim(s5), '') <> '' AND NOT regexp_matches(s5, 'O\s*\(') THEN 'S5:E5:4:true' END, CASE WHEN length(trim(code)) < 20 THEN 'S7:E7:4:true' ELSE CASE WHEN lang IS NULL OR lang <> 'en' THEN 'S7:E7:4:true' END END,
  CASE WHEN contains(s5, 'O(n log n)') AND NOT contains(lower(s3), 'sort') AND len(regexp_extract_all(code, '\bfor\s+|while\s+')) >= 2 THEN 'S5:E5:2:false' END], lambda x: x IS NOT NULL)) AS e FROM d)
SELECT doc_id, split_part(e, ':', 1) AS step_id, split_part(e, ':', 2) AS error_type, split_part(e, ':', 3)::INTEGER AS strength, split_part(e, ':', 4) = 'true' AS indicates_invalid FROM x""")
def q33_structural_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with short, absent and doubtful steps, and whole texts as their code; English stands for a supported language."""
    at = F.col("doc_id")
    step = lambda i: F.when(at % 7 == i, " short ").when(at % 9 == i, None).otherwise("a step of enough letters")
    steps = [step(i) for i in range(7)]
    steps[4] = F.when(at % 5 == 0, "it takes O(n log n) steps").when(at % 5 == 1, "it takes O (n) steps").when(at % 5 == 2, "it takes a long time").when(at % 5 == 3, " ")
    steps[2] = F.when(at % 4 == 0, "we Sort the numbers first").otherwise("we count the numbers twice")
    given = F.map_from_arrays(F.array(*(F.lit(f"S{i}") for i in range(1, 8))), F.array(*steps))
    code = F.when(at % 6 == 0, "").when(at % 6 == 1, "short").otherwise(F.concat(F.lit("for i in x: while j: "), "text"))
    found = fusion.structural_evidence(given, F.when(F.col("lang") == "en", "python").otherwise(F.col("lang")), code)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("e"))
    return rows.select("doc_id", "e.step_id", "e.error_type", "e.strength", "e.indicates_invalid")


@query(f"""WITH r AS (SELECT p_partkey, p_brand AS category, bin FROM ({_BINS})),
s AS (SELECT category, bin, count(*) AS n FROM r GROUP BY category, bin),
b AS (SELECT category, bin, n, least(n, greatest(1, least(3, 180 // (SELECT count(*) FROM s)))) AS base FROM s),
t AS (SELECT least(180 - sum(base), sum(n - base)) AS seats, sum(n - base) AS room FROM b),
i AS (SELECT category, bin, base, seats, (seats * (n - base)) // room AS gain, (seats * (n - base)) % room AS rest FROM b, t),
k AS (SELECT category, bin, base + gain + CASE WHEN row_number() OVER (ORDER BY rest DESC, category, bin) <= seats - sum(gain) OVER () THEN 1 ELSE 0 END AS quota FROM i),
d AS (SELECT p_partkey, category, bin, row_number() OVER (PARTITION BY category, bin ORDER BY md5(concat_ws(chr(31), '42', category, bin, p_partkey::VARCHAR)), p_partkey) AS n FROM r)
SELECT p_partkey, category || '|' || bin AS quota_cell, false AS filled_beyond_quota FROM d JOIN k USING (category, bin) WHERE n <= quota""")
def q34_stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _binned(spark, sf_dir).select("p_partkey", "bin", F.col("p_brand").alias("category"), F.array("p_brand").alias("categories"))
    return sample.draw(parts, 180, "p_partkey")


@query(f"""WITH r AS (SELECT p_partkey, p_type AS category, CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 40 THEN 'medium' ELSE 'large' END AS bin FROM part),
s AS (SELECT category, bin, count(*) AS n FROM r GROUP BY category, bin),
w AS (SELECT *, least(n, 5, greatest(1, least(3, 100 // (SELECT count(*) FROM s)))) AS wanted FROM s),
k AS (SELECT category, bin, CASE WHEN coalesce(sum(wanted) OVER (PARTITION BY category ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 THEN wanted ELSE 0 END AS quota FROM w),
d AS (SELECT p_partkey, category, bin, row_number() OVER (PARTITION BY category, bin ORDER BY md5(concat_ws(chr(31), '42', category, bin, p_partkey::VARCHAR)), p_partkey) AS n FROM r),
t AS (SELECT p_partkey, category || '|' || bin AS quota_cell, n <= quota AS picked FROM d JOIN k USING (category, bin)),
f AS (SELECT p_partkey, quota_cell, row_number() OVER (ORDER BY md5(concat_ws(chr(31), '42', p_partkey::VARCHAR)), p_partkey) AS n FROM t WHERE NOT picked)
SELECT p_partkey, quota_cell, false AS filled_beyond_quota FROM t WHERE picked UNION ALL SELECT p_partkey, quota_cell, true FROM f WHERE n <= 100 - (SELECT count(*) FROM t WHERE picked)""")
def q67_capped_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw in which the cap of each category binds, so that the rest is filled beyond the quotas."""
    bin_ = F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 40, "medium").otherwise("large")
    parts = table(spark, sf_dir, "part").select("p_partkey", bin_.alias("bin"), F.col("p_type").alias("category"), F.array("p_type").alias("categories"))
    return sample.draw(parts, 100, "p_partkey", share=0.05)


#: Traits of a text, in the order in which their cells draw; a text without any is plain.
TRAITS = {"digits": "[0-9]", "pipes": r"\|", "question": r"\?", "shouting": SHOUTING}
_TRAITS = [*TRAITS, "~plain"]
_LIST = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for t, p in TRAITS.items())


def _serial_sql(target: int) -> str:
    """Cell after cell in name order, each from what those before it have left."""
    parts, before = [], []
    for i, trait in enumerate(_TRAITS):
        used = " UNION ALL ".join(f"SELECT doc_id FROM c{j}" for j in before) or "SELECT NULL::BIGINT WHERE false"
        parts.append(
            f"c{i} AS MATERIALIZED (SELECT doc_id, '{trait}|' || x.bin AS quota_cell FROM (SELECT doc_id, bin, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws(chr(31), '42', category, bin, doc_id::VARCHAR)), doc_id) AS n"
            f" FROM e WHERE category = '{trait}' AND doc_id NOT IN ({used})) x JOIN k ON k.category = '{trait}' AND k.bin = x.bin WHERE n <= quota)"
        )
        before.append(i)
    return f"""WITH t AS (SELECT doc_id, CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 3000 THEN 'medium' ELSE 'long' END AS bin, list_filter([{_LIST}], lambda x: x IS NOT NULL) AS found FROM documents),
r AS (SELECT doc_id, bin, CASE WHEN len(found) = 0 THEN ['~plain'] ELSE found END AS categories FROM t),
e AS MATERIALIZED (SELECT doc_id, bin, unnest(categories) AS category FROM r),
s AS (SELECT category, bin, count(*) AS n FROM e GROUP BY category, bin),
b AS (SELECT category, bin, n, least(n, greatest(1, least(3, {target} // (SELECT count(*) FROM s)))) AS base FROM s),
y AS (SELECT least({target} - sum(base), sum(n - base)) AS seats, sum(n - base) AS room FROM b),
i AS (SELECT category, bin, base, seats, (seats * (n - base)) // room AS gain, (seats * (n - base)) % room AS rest FROM b, y),
k AS MATERIALIZED (SELECT category, bin, base + gain + CASE WHEN row_number() OVER (ORDER BY rest DESC, category, bin) <= seats - sum(gain) OVER () THEN 1 ELSE 0 END AS quota FROM i),
{", ".join(parts)},
p AS ({" UNION ALL ".join(f"SELECT * FROM c{j}" for j in before)}),
f AS (SELECT doc_id, categories[1] || '|' || bin AS quota_cell, row_number() OVER (ORDER BY md5(concat_ws(chr(31), '42', doc_id::VARCHAR)), doc_id) AS n FROM r WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, quota_cell, false AS filled_beyond_quota FROM p UNION ALL SELECT doc_id, quota_cell, true FROM f WHERE n <= {target} - (SELECT count(*) FROM p)"""


@query(_serial_sql(150))
def q72_competing_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw in which a document is eligible in the cells of all its traits, so that cells compete for it."""
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(t)) for t, p in TRAITS.items())))
    categories = F.when(F.size(found) == 0, F.array(F.lit("~plain"))).otherwise(found)
    bin_ = F.when(F.length("text") < 1000, "short").when(F.length("text") < 3000, "medium").otherwise("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", bin_.alias("bin"), categories.alias("categories"))
    return sample.draw(docs.withColumn("category", F.col("categories")[0]), 150, "doc_id", share=1.0)


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, len(ls) AS n, list_transform(range(1, 8), lambda i: CASE WHEN i < 7 THEN coalesce(trim(ls[i], ' ' || chr(9) || chr(10) || chr(13)), '') ELSE coalesce(trim(array_to_string(ls[7:], chr(10)), ' ' || chr(9) || chr(10) || chr(13)), '') END) AS st FROM l)
SELECT doc_id, least(n, 7)::INTEGER AS n_steps, array_to_string(list_filter(list_transform(range(1, 8), lambda i: CASE WHEN st[i] = '' THEN 'S' || i END), lambda x: x IS NOT NULL), ',') AS missing,
  sha256(array_to_string(st, chr(30))) AS digest FROM s""")
def q35_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made into Markdown answers by their lines, and read back; the last section has all lines from the seventh on."""
    lines = F.split("text", "\n")
    heading = lambda x, i: F.when(i < 7, F.concat(F.lit("### S"), (i + 1).cast("string"), F.lit(" step\n"), x)).otherwise(x)
    raw = F.concat(F.array_join(F.transform(lines, heading), "\n"), F.lit("\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.sections(raw).alias("steps"))
    steps = F.col("steps")
    return docs.select("doc_id", F.size(steps).alias("n_steps"), F.array_join(text.missing_sections(steps), ",").alias("missing"), text.steps_digest(steps).alias("digest"))


@query("""SELECT * FROM (PIVOT (SELECT p_brand AS category, bin FROM (""" + _BINS + """) UNION ALL SELECT 'total', bin FROM (""" + _BINS + """)) ON bin IN ('low', 'mid', 'high') USING count(*) GROUP BY category)
JOIN (SELECT category, count(*)::BIGINT AS total FROM (SELECT p_brand AS category FROM part UNION ALL SELECT 'total' FROM part) GROUP BY category) USING (category)""")
def q38_pivot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.matrix(_binned(spark, sf_dir).select(F.col("p_brand").alias("category"), "bin"), ("low", "mid", "high"))
