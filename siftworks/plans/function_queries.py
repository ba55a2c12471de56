"""Queries over the text, key and classification functions: titles, links, lists, modes, comparisons, sections, tags, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, compare, noisy_json, tags, text
from ..operators import gate, sample
from ..sources import dataset_dirs
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: White space as ``text.SPACE`` has it, for DuckDB.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def phrase(of: str, phrases: tuple[str, ...]) -> Column:
    """The phrase with the number of the row's key modulo their count."""
    return F.get(F.array(*map(F.lit, phrases)), F.pmod(F.col(of), F.lit(len(phrases))).cast("int"))


def phrase_sql(of: str, phrases: tuple[str, ...]) -> str:
    listed = ", ".join("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in phrases)
    return f"([{listed}])[{of} % {len(phrases)} + 1]"


def joined(c: Column) -> Column:
    return F.array_join(c, ",")


DESCRIBED = (
    "Print any of them.", "You may output any suitable answer", "any correct permutation is fine", "print any permutation", "There are multiple solutions.", "If there are several possible good answers, print one",
    "Output the edges, in any order", "This is an interactive problem; flush the output", "Flushing is not needed, interactively", "sprint anyway", "Output them in any arbitrary order", "plain",
)
CODED = (
    "x = raw_input()", "for i in xrange (3):", "print 5", "print >> f, 1", "d.iteritems()", "d. has_key (1)", "basestring", "unicode (x)", "long(2)", "except ValueError, e :", "raise Oops , 1", "`x`", "print(5)",
)


def _tag_sql(patterns: tuple[tuple[str, str], ...], of: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({of}, '{p}') THEN '{name}' END" for name, p in patterns)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


_DESCRIBED_SQL = phrase_sql("doc_id", DESCRIBED)
_CODED_SQL = phrase_sql("doc_id", CODED)


@query(f"""WITH d AS (SELECT doc_id, {_DESCRIBED_SQL} || chr(10) || text AS de, {_CODED_SQL} || chr(10) || text AS co FROM documents)
SELECT doc_id, {_tag_sql(tags.MANY_ANSWERS, "de")} AS many, {_tag_sql(tags.INTERACTIVE, "de")} AS interactive, {_tag_sql(tags.PYTHON2, "co")} AS python2 FROM d""")
def q39_admission_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts behind a phrase each, as descriptions and as code."""
    docs = table(spark, sf_dir, "documents")
    described, coded = F.concat(phrase("doc_id", DESCRIBED), F.lit("\n"), "text"), F.concat(phrase("doc_id", CODED), F.lit("\n"), "text")
    return docs.select("doc_id", joined(tags.many_answers(described)).alias("many"), joined(tags.interactive(described)).alias("interactive"), joined(tags.python2(coded)).alias("python2"))


def _title_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace({strip_sql(x)}, '^p\\d+\\s+', '')), '[^a-z0-9]+', ' ', 'g'))"


@query(rf"""WITH t AS (SELECT p_partkey, '  p' || p_partkey % 50 || chr(9) || upper(p_name) || CASE p_partkey % 3 WHEN 0 THEN ' - ' || p_type || '!' WHEN 1 THEN ' - a - ' || p_name ELSE '' END || ' ' AS name FROM part),
b AS (SELECT p_partkey, name, regexp_replace({strip_sql("name")}, '^p\d+\s+', '') AS bare FROM t),
c AS (SELECT p_partkey, {_title_sql("name")} AS title, {_title_sql("bare")} AS whole, CASE WHEN contains(bare, ' - ') THEN {_title_sql("string_split(bare, ' - ')[-1]")} ELSE '' END AS last FROM b)
SELECT p_partkey, title, concat_ws('|', whole, CASE WHEN last NOT IN ('', whole) THEN last END) AS candidates FROM c""")
def q40_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" - "), "p_type", F.lit("!"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" - a - "), "p_name")).otherwise("")
    name = F.concat(F.lit("  p"), (F.col("p_partkey") % 50).cast("string"), F.lit("\t"), F.upper("p_name"), tail, F.lit(" "))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", text.normalized_title("name").alias("title"), F.array_join(text.title_candidates("name"), "|").alias("candidates"))


@query(r"""WITH l AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' https://codeforces.com/problemset/problem/' || page_id || '/b' || page_id % 3 WHEN 1 THEN 'https://codeforces.com/contest/' || page_id || '/problem/C'
  WHEN 2 THEN 'http://atcoder.jp/contests/abc' || page_id || '/tasks/abc_' || page_id || '?lang=en' WHEN 3 THEN 'https://www.codechef.com/problems/P' || page_id || '#x' ELSE url END AS link FROM pages)
SELECT page_id, CASE WHEN regexp_matches(link, 'codeforces\.com/(?:problemset/problem|contest)/(\d+)/(?:problem/)?([A-Za-z]\d?)')
    THEN 'codeforces:' || regexp_extract(link, 'codeforces\.com/(?:problemset/problem|contest)/(\d+)/(?:problem/)?([A-Za-z]\d?)', 1) || ':' || upper(regexp_extract(link, 'codeforces\.com/(?:problemset/problem|contest)/(\d+)/(?:problem/)?([A-Za-z]\d?)', 2))
  WHEN regexp_matches(link, 'atcoder\.jp/contests/([^/]+)/tasks/([^/?#]+)') THEN 'atcoder:' || regexp_extract(link, 'atcoder\.jp/contests/([^/]+)/tasks/([^/?#]+)', 1) || ':' || regexp_extract(link, 'atcoder\.jp/contests/([^/]+)/tasks/([^/?#]+)', 2)
  WHEN regexp_matches(link, 'codechef\.com/problems/([^/?#]+)') THEN 'codechef::' || regexp_extract(link, 'codechef\.com/problems/([^/?#]+)', 1) END AS link_key,
  CASE WHEN page_id % 3 = 0 AND page_id > 0 AND page_id % 4 <> 1 THEN 'codeforces:' || page_id || ':' || CASE page_id % 4 WHEN 2 THEN 'B1' ELSE 'A' END END AS row_key FROM l""")
def q41_link_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of four kinds, and rows of which only one source has keys, without key for contest 0 or a blank index."""
    n, at = F.col("page_id").cast("string"), F.col("page_id")
    link = (
        F.when(at % 5 == 0, F.concat(F.lit(" https://codeforces.com/problemset/problem/"), n, F.lit("/b"), (at % 3).cast("string")))
        .when(at % 5 == 1, F.concat(F.lit("https://codeforces.com/contest/"), n, F.lit("/problem/C")))
        .when(at % 5 == 2, F.concat(F.lit("http://atcoder.jp/contests/abc"), n, F.lit("/tasks/abc_"), n, F.lit("?lang=en")))
        .when(at % 5 == 3, F.concat(F.lit("https://www.codechef.com/problems/P"), n, F.lit("#x")))
        .otherwise(F.col("url"))
    )
    source = F.when(at % 3 == 0, "CODEFORCES").otherwise("ATCODER")
    index = F.when(at % 4 == 1, " ").when(at % 4 == 2, " b1").otherwise("a")
    return table(spark, sf_dir, "pages").select("page_id", text.link_key(link).alias("link_key"), text.row_key(source, at, index).alias("row_key"))


@query(r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '["' || p_brand || '", "' || p_type || '", " "]' WHEN 1 THEN '[''' || p_brand || ''', ''x y'']' WHEN 2 THEN p_brand || ' ,, ' || p_type || ', z ' WHEN 3 THEN '[]' END AS t FROM part)
SELECT p_partkey, coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '[\[\]''"]', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS items FROM t""")
def q42_list_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("p_partkey") % 5
    made = (
        F.when(at == 0, F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('", " "]')))
        .when(at == 1, F.concat(F.lit("['"), "p_brand", F.lit("', 'x y']")))
        .when(at == 2, F.concat("p_brand", F.lit(" ,, "), "p_type", F.lit(", z ")))
        .when(at == 3, F.lit("[]"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.text_list(made), "|").alias("items"))


MODES, LANGUAGES = ("exact", " float_tolerance ", "", "token", "special"), (" C++", "py", "Python3", "PY3 ", "rust")
_MODE_SQL = phrase_sql("p_partkey", MODES)
_LANGUAGE_SQL = phrase_sql("p_partkey", LANGUAGES)
_ERROR_SQL = phrase_sql("p_partkey", (" e3", "E9", "E8 ", "none", "e1"))
_SURE_SQL = phrase_sql("p_partkey", ("0.25", "7", "-1", "high"))
_SUFFIX_SQL = phrase_sql("p_partkey", ("", "2", "s3"))


@query(f"""WITH t AS (SELECT p_partkey, trim({_MODE_SQL}) AS m, lower(trim({_LANGUAGE_SQL})) AS l, upper(trim({_ERROR_SQL})) AS e, {_SURE_SQL} AS c, {_SUFFIX_SQL} AS s, p_size FROM part)
SELECT p_partkey, CASE WHEN m IN ('exact', '') THEN 'token' WHEN m = 'float_tolerance' THEN 'float' ELSE m END AS mode, CASE WHEN l = 'c++' THEN 'cpp' WHEN l IN ('py', 'py3', 'python3') THEN 'python' ELSE l END AS language,
  CASE WHEN regexp_matches(e, '^E[1-8]$') THEN e ELSE 'NONE' END AS error_type, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(try_cast(c AS DOUBLE), 0.5))) AS confidence,
  'P' || p_partkey || '#' || CASE WHEN s = '' THEN 'injected' ELSE 'injected-' || s END AS candidate_id, CASE WHEN p_size % 7 = 0 THEN 2.0 ELSE (p_size % 7)::DOUBLE END AS seconds, CASE WHEN p_size % 7 = 0 THEN 'default' ELSE 'dataset' END AS seconds_source,
  least(CASE WHEN p_size % 7 = 0 THEN 2.0 ELSE p_size % 7 END, 4.0)::DOUBLE AS effective_seconds FROM t""")
def q43_normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes, languages, error types, confidences, names, and limits with where they came from."""
    from ..operators import verdicts

    own = (F.col("p_size") % 7).cast("double")
    seconds, source = text.value_or_default(own, 2.0)
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.comparison_mode(phrase("p_partkey", MODES)).alias("mode"), text.language(phrase("p_partkey", LANGUAGES)).alias("language"), text.error_type(phrase("p_partkey", (" e3", "E9", "E8 ", "none", "e1"))).alias("error_type"), text.clamped_confidence(phrase("p_partkey", ("0.25", "7", "-1", "high"))).alias("confidence"),
        text.candidate_id(F.concat(F.lit("P"), F.col("p_partkey").cast("string")), text.candidate_name(F.lit("injected"), phrase("p_partkey", ("", "2", "s3")))).alias("candidate_id"),
        seconds.alias("seconds"), source.alias("seconds_source"), verdicts.effective_limit(own, 2.0, 4.0).alias("effective_seconds"),
    )


@query("""WITH p AS (SELECT p_partkey, printf('%.2f', p_retailprice) AS a, printf('%.7f', p_retailprice + CASE p_partkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.0001 ELSE 0.0000001 END) AS b FROM part)
SELECT p_partkey, a || ' x' = b || '  x' AS as_tokens, a = b OR abs(a::DOUBLE - b::DOUBLE) <= 1e-6 * greatest(1.0, abs(b::DOUBLE)) AS as_numbers FROM p""")
def q44_scaled_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older comparison: the tolerance grows with the wanted number's size."""
    at = F.col("p_partkey") % 3
    shift = F.when(at == 0, F.lit(0.01)).when(at == 1, F.lit(0.0001)).otherwise(F.lit(0.0000001))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.format_string("%.2f", "p_retailprice").alias("a"), F.format_string("%.7f", F.col("p_retailprice") + shift).alias("b"))
    a, b = F.concat("a", F.lit(" x")), F.concat("b", F.lit("  x"))
    return rows.select("p_partkey", compare.outputs_equal_scaled(a, b).alias("as_tokens"), compare.outputs_equal_scaled(a, b, "float").alias("as_numbers"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN '{"id":' || o_orderkey || '}' ELSE '{"id":' || o_orderkey || ',"s":{"t":"a}b"}}' END AS found FROM orders""")
def q45_noisy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in fences, in running text with other braces, alone, and none."""
    n, at = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    made = F.concat(F.lit('{"id": '), n, F.lit(', "s": {"t": "a}b"}}'))
    said = (
        F.when(at == 0, F.concat(F.lit("Sure {no}:\n```json\n"), made, F.lit("\n```\nand {\"id\": 0}")))
        .when(at == 1, F.concat(F.lit("I think {this} is it: "), made, F.lit(" or {\"id\": 1}?")))
        .when(at == 2, F.concat(F.lit(' {"id": '), n, F.lit("}")))
        .otherwise(F.lit("{not it} [1, 2]"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", noisy_json.object_text(said).alias("found"))


CONTEST = {"blue": "dp", "new": " Graphs", "large": "segment tree", "small": "Binary Search ", "hot": "greedy", "red": "math", "old": "no such tag"}
TOPIC = {"STANDARD": "searching", "ECONOMY": "sorting", "MEDIUM": "graph theory", "PROMO": "", "LARGE": "data structures", "SMALL": "nothing"}
_WORDS_SQL = phrase_sql("p_size", ("count them", "a shortest path of edges", "use Dynamic Programming", "minimise by Binary Search", "keep a heap", "greedy choice"))


def _case_sql(of: str, values: dict[str, str | int]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in values.items()) + " END"


_RANK = {c: i for i, c in enumerate(classify.CATEGORIES)}
_CATEGORY_OF = {"dp": "DP", "graphs": "Graph", "segment tree": "DataStructure", "binary search": "BinarySearch", "greedy": "Greedy", "math": "Simulation", "searching": "BinarySearch", "sorting": "Simulation", "graph theory": "Graph", "data structures": "DataStructure"}
_KEYWORD_SQL = "CASE p_size % 6 WHEN 1 THEN 'Graph:shortest path' WHEN 2 THEN 'DP:dynamic programming' WHEN 3 THEN 'BinarySearch:binary search' WHEN 4 THEN 'DataStructure:heap' WHEN 5 THEN 'Greedy:greedy' END"
#: Rating from the price, 0 for none; difficulty label and code from size and key.
_RATING_SQL = "floor((p_retailprice - 900) * 25)::BIGINT"
_BIN_SQL = f"CASE WHEN {_RATING_SQL} = 0 THEN NULL WHEN {_RATING_SQL} < 1200 THEN '<1200' WHEN {_RATING_SQL} < 1600 THEN '1200-1599' WHEN {_RATING_SQL} < 2000 THEN '1600-1999' WHEN {_RATING_SQL} < 2400 THEN '2000-2399' ELSE '>=2400' END"
LABELS = ("easy", "MEDIUM", "Very_Hard ", "UNKNOWN_DIFFICULTY", "harder")
_LABEL_SQL = phrase_sql("p_size", LABELS)

#: Every part as a pool row: tags, description, rating and difficulty, with half of the ratings left out.
_POOL_SQL = f"""SELECT p_partkey, p_partkey % 2 = 0 AS rated, {_BIN_SQL} AS rating_bin, p_partkey % 30 AS code, {_LABEL_SQL} AS label, p_brand,
  lower(trim({_case_sql("split_part(p_name, ' ', 1)", CONTEST)})) AS t1, {_case_sql("p_type", TOPIC)} AS t2, {_KEYWORD_SQL} AS kw FROM part"""
_CLASSED_SQL = f"""WITH r AS ({_POOL_SQL}), k AS (SELECT *, {_case_sql("t1", {t: _RANK[c] for t, c in _CATEGORY_OF.items()})} AS k1, {_case_sql("t2", {t: _RANK[c] for t, c in _CATEGORY_OF.items()})} AS k2 FROM r),
f AS (SELECT *, coalesce(least(k1, k2), 9) AS k0 FROM k),
c AS (SELECT *, CASE WHEN k0 < 9 THEN {[*classify.CATEGORIES]}[k0 + 1] WHEN kw IS NOT NULL THEN split_part(kw, ':', 1) ELSE 'unclassified' END AS category,
  CASE WHEN k0 < 9 THEN CASE WHEN k1 = k0 THEN 'cf_tags' ELSE 'taco' END WHEN kw IS NOT NULL THEN 'heuristic' ELSE 'unclassified' END AS category_source,
  CASE WHEN k0 < 9 THEN array_to_string(list_sort(list_distinct(list_filter([CASE WHEN k1 = k0 THEN t1 END, CASE WHEN k2 = k0 THEN t2 END], lambda x: x IS NOT NULL))), ',') WHEN kw IS NOT NULL THEN split_part(kw, ':', 2) ELSE '' END AS matched,
  concat_ws(',', CASE WHEN k0 < 9 THEN {[*classify.CATEGORIES]}[k0 + 1] END, CASE WHEN k1 <> k2 THEN {[*classify.CATEGORIES]}[greatest(k1, k2) + 1] END) AS tagged,
  CASE WHEN rated AND rating_bin IS NOT NULL THEN rating_bin WHEN upper(trim(label)) = 'EASY' THEN '<1200' WHEN upper(trim(label)) = 'MEDIUM' THEN '1200-1599' WHEN upper(trim(label)) = 'VERY_HARD' THEN '>=2400' WHEN upper(trim(label)) = 'HARDER' THEN '2000-2399'
    WHEN code BETWEEN 1 AND 2 THEN '<1200' WHEN code BETWEEN 3 AND 6 THEN '1600-1999' WHEN code BETWEEN 7 AND 9 THEN '1200-1599' WHEN code BETWEEN 10 AND 12 THEN '1600-1999' WHEN code BETWEEN 13 AND 16 THEN '2000-2399' WHEN code BETWEEN 17 AND 28 THEN '>=2400' ELSE 'unrated' END AS bin,
  CASE WHEN rated AND rating_bin IS NOT NULL THEN 'cf_rating' WHEN upper(trim(label)) <> 'UNKNOWN_DIFFICULTY' THEN 'taco' WHEN code BETWEEN 1 AND 28 THEN 'cc_enum' ELSE 'none' END AS bin_source,
  CASE WHEN rated AND rating_bin IS NOT NULL THEN rating_bin WHEN code BETWEEN 1 AND 2 THEN '<1200' WHEN code BETWEEN 3 AND 6 THEN '1600-1999' WHEN code BETWEEN 7 AND 9 THEN '1200-1599' WHEN code BETWEEN 10 AND 11 THEN '1600-1999' WHEN code >= 12 THEN '2000-2399' ELSE 'unknown' END AS pool_bin FROM f)"""


def pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.floor((F.col("p_retailprice") - 900) * 25).cast("int")
    word = F.get(F.split("p_name", " "), F.lit(0))
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.array(F.try_element_at(text.literal_map(CONTEST), word)).alias("cf_tags"), F.array(F.try_element_at(text.literal_map(TOPIC), F.col("p_type"))).alias("taco_tags"), F.lit(None).cast("array<string>").alias("taco_skill_types"),
        phrase("p_size", ("count them", "a shortest path of edges", "use Dynamic Programming", "minimise by Binary Search", "keep a heap", "greedy choice")).alias("description"), F.when(F.col("p_partkey") % 2 == 0, rating).alias("cf_rating"), phrase("p_size", LABELS).alias("taco_difficulty"), (F.col("p_partkey") % 30).cast("int").alias("difficulty"),
    )


@query(f"{_CLASSED_SQL} SELECT p_partkey, category, category_source, matched, tagged FROM c")
def q10_priority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, where it came from, the tags that name it, and all categories that the tags name."""
    made = classify.assignment("cf_tags", "taco_tags", "description")
    rows = pool_rows(spark, sf_dir).select("p_partkey", made.alias("a"), joined(classify.categories_of("cf_tags", "taco_tags")).alias("tagged"))
    return rows.select("p_partkey", F.col("a.category").alias("category"), F.col("a.source").alias("category_source"), joined(F.col("a.matched")).alias("matched"), "tagged")


@query(f"{_CLASSED_SQL} SELECT p_partkey, pool_bin, bin, bin_source FROM c")
def q08_rating_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = classify.sampling_bin("cf_rating", "taco_difficulty", "difficulty")
    return pool_rows(spark, sf_dir).select("p_partkey", classify.pool_bin("cf_rating", "difficulty").alias("pool_bin"), made["bin"].alias("bin"), made["source"].alias("bin_source"))


@query(f"""{_CLASSED_SQL} SELECT p_partkey, category, category_source, bin, bin_source, CASE WHEN category = 'unclassified' OR contains(',' || tagged || ',', ',' || category || ',') THEN tagged ELSE concat_ws(',', category, nullif(tagged, '')) END AS categories FROM c
WHERE category IN ('DP', 'Graph', 'Greedy') AND bin IN ('<1200', '1200-1599', '>=2400')""")
def q46_prepared_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.eligible(sample.prepared(pool_rows(spark, sf_dir)), ("DP", "Graph", "Greedy"), ("<1200", "1200-1599", ">=2400"))
    return rows.select("p_partkey", F.col("primary_category").alias("category"), "category_source", F.col("difficulty_bin").alias("bin"), F.col("difficulty_bin_source").alias("bin_source"), joined(F.col("categories_all")).alias("categories"))


@query(f"""{_CLASSED_SQL} SELECT count(*) FILTER (category IN ('DP', 'Graph', 'Greedy') AND bin IN ('<1200', '1200-1599', '>=2400'))::BIGINT AS eligible, count(*) FILTER (category NOT IN ('DP', 'Graph', 'Greedy'))::BIGINT AS no_category,
  count(*) FILTER (category IN ('DP', 'Graph', 'Greedy') AND bin NOT IN ('<1200', '1200-1599', '>=2400'))::BIGINT AS no_bin FROM c""")
def q47_eligibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.eligibility_counts(sample.prepared(pool_rows(spark, sf_dir)), ("DP", "Graph", "Greedy"), ("<1200", "1200-1599", ">=2400"))


@query(f"{_CLASSED_SQL} SELECT category, bin, count(*)::BIGINT AS n, grouping(category, bin)::BIGINT AS grain FROM c GROUP BY GROUPING SETS ((category), (bin), (category, bin), ())")
def q09_supply_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.prepared(pool_rows(spark, sf_dir)).select(F.col("primary_category").alias("category"), F.col("difficulty_bin").alias("bin"))
    return sample.supply_counts(rows)


_SAID = "'[' || regexp_replace(coalesce(text, ''), '[#`' || chr(10) || chr(13) || ']', ' ', 'g') || ']'"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE {_SAID} END AS code, sha256('## S1' || chr(10) || 'one ' || source || chr(10) || chr(10) || '## S2' || chr(10) || {_SAID} || chr(10) || chr(10) || '## S4' || chr(10) || 'four ' || lang) AS merged_sha256, 'S3,S5,S6,S7' AS missing FROM documents""")
def q48_merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a document as a code block in an answer, and as a section of an answer over those of another."""
    said = F.concat(F.lit("["), F.regexp_replace(F.coalesce("text", F.lit("")), "[#`\n\r]", " "), F.lit("]"))
    fence = F.when(F.col("doc_id") % 3 == 0, "```python\n").when(F.col("doc_id") % 3 == 1, "```c++ \n").otherwise("```java\n")
    base = F.concat(F.lit("# S1 title\nno\n### S1 begin\none "), "source", F.lit("\n\n##### S2\nold "), "source", F.lit("\n"))
    patch = F.concat(F.lit("## S2 again\n"), said, F.lit("\n\n## S4\nfour "), "lang", F.lit("\n"))
    steps = text.merged_sections(text.sections(base), text.sections(patch))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.code_block(F.concat(F.lit("see\n"), fence, said, F.lit("\n```\n"))).alias("code"), steps.alias("steps"))
    return rows.select("doc_id", "code", F.sha2(text.rendered_sections("steps"), 256).alias("merged_sha256"), joined(text.missing_sections("steps")).alias("missing"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'S1=a' || o_orderkey || ',S3=last' ELSE 'S2=b' || o_orderkey END AS steps, 'f(' || o_orderkey || ')' AS code, CASE WHEN o_orderkey % 2 = 0 THEN 'cpp' ELSE 'python' END AS language FROM orders""")
def q49_solution_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions in the full form, with odd and repeated step ids, and in the short one."""
    n = F.col("o_orderkey").cast("string")
    full = F.concat(F.lit('{"steps": [{"step_id": "s03", "content": "first"}, {"step_id": "S1", "content": "a'), n, F.lit('"}, {"step_id": "S9", "content": "no"}, {"step_id": "S3", "content": "last"}], "code": {"language": "C++", "code": "f('), n, F.lit(')"}}'))
    short = F.concat(F.lit('{"S2": "b'), n, F.lit('", "note": "x", "code": "f('), n, F.lit(')"}'))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, full).otherwise(short).alias("text"))
    steps = F.array_sort(F.transform(F.map_entries("steps"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return dataset_dirs.solutions(rows).select("o_orderkey", joined(steps).alias("steps"), "code", "language")
