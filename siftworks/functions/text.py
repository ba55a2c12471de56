"""Text and key functions as Spark columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: patterns of links, titles, sections and code fences. ----
CONTEST_LINK = r"codeforces\.com/(?:problemset/problem|contest)/(\d+)/(?:problem/)?([A-Za-z]\d?)"
TASK_LINK = r"atcoder\.jp/contests/([^/]+)/tasks/([^/?#]+)"
PRACTICE_LINK = r"codechef\.com/problems/([^/?#]+)"
LEADING_NUMBER = r"^p\d+\s+"
HEADING = r"(?m)^#{2,5}\s*(S[1-7])\b"
HEAD = r"(?m)^##\s+(?=S[1-7])"
FENCE = r"(?s)```(?:python|py|cpp|c\+\+)?\s*\n(.*?)```"
STEPS = ("S1", "S2", "S3", "S4", "S5", "S6", "S7")
#: Old names of comparison modes.
MODE_ALIASES = {"exact": "token", "float_tolerance": "float"}
LANGUAGE_ALIASES = {"c++": "cpp", "py": "python", "py3": "python", "python3": "python"}

#: White space as Python's ``str.split`` sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def stripped(c: Column | str) -> Column:
    """Without white space at either end, newlines and wide spaces included."""
    return F.regexp_replace(column(c), rf"^{SPACE}|{SPACE}$", "")


def byte_length(c: Column | str) -> Column:
    return F.octet_length(column(c))


def case_bytes(cases: Column | str, first: str = "input", second: str = "expected") -> Column:
    """Bytes of both fields over an array of cases."""
    return F.aggregate(column(cases), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x[first]) + F.octet_length(x[second]))


def fits(case_in: Column | str, case_out: Column | str, limit: int) -> Column:
    return (byte_length(case_in) <= limit) & (byte_length(case_out) <= limit)


def normalized_title(c: Column | str) -> Column:
    bare = F.regexp_replace(stripped(F.coalesce(column(c), F.lit(""))), LEADING_NUMBER, "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def title_candidates(c: Column | str) -> Column:
    """The whole title and its last part after `` - ``, normalised, distinct, blanks dropped."""
    bare = F.regexp_replace(stripped(F.coalesce(column(c), F.lit(""))), LEADING_NUMBER, "")
    clean = lambda x: F.trim(F.regexp_replace(F.lower(F.regexp_replace(stripped(x), LEADING_NUMBER, "")), "[^a-z0-9]+", " "))
    last = F.when(F.instr(bare, " - ") > 0, clean(F.element_at(F.split(bare, " - "), -1))).otherwise(F.lit(""))
    return F.filter(F.array_distinct(F.array(clean(bare), last)), lambda x: x != "")


def link_key(c: Column | str) -> Column:
    """Key of a problem link, by the first kind of link that matches; null for none."""
    text = stripped(column(c))
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    return F.coalesce(
        F.when(text.rlike(CONTEST_LINK), F.concat_ws(":", F.lit("codeforces"), part(CONTEST_LINK, 1), F.upper(part(CONTEST_LINK, 2)))),
        F.when(text.rlike(TASK_LINK), F.concat_ws(":", F.lit("atcoder"), part(TASK_LINK, 1), part(TASK_LINK, 2))),
        F.when(text.rlike(PRACTICE_LINK), F.concat_ws(":", F.lit("codechef"), F.lit(""), part(PRACTICE_LINK, 1))),
    )


def row_key(source: Column | str, contest: Column | str, index: Column | str) -> Column:
    """Key of a row: only of the one source whose contests can be told exactly, with a contest and an index."""
    at = F.upper(stripped(F.coalesce(column(index), F.lit(""))))
    known = (column(source) == "CODEFORCES") & (F.coalesce(column(contest), F.lit(0)) != 0) & (at != "")
    return F.when(known, F.concat_ws(":", F.lit("codeforces"), column(contest).cast("string"), at))


def composite_id(split: Column | str, shard: Column | str, record: Column | str) -> Column:
    return F.format_string("cc-%s-%03d-%04d", column(split), column(shard).cast("int"), column(record).cast("int"))


def id_parts(c: Column | str) -> Column:
    """split, shard and record_index of a composite id; null where the text is none."""
    p = F.split(column(c), "-")
    good = column(c).rlike(r"^cc-[^-]+-\d+-\d+$")
    return F.when(good, F.struct(F.get(p, F.lit(1)).alias("split"), F.get(p, F.lit(2)).cast("int").alias("shard"), F.get(p, F.lit(3)).cast("int").alias("record_index")))


def text_list(c: Column | str) -> Column:
    """A list written as JSON, as a Python literal, or as loose comma-separated text; trimmed, blanks dropped."""
    text = stripped(F.coalesce(column(c), F.lit("")))
    listed = F.from_json(text, "array<string>")
    loose = F.split(F.regexp_replace(text, r"[\[\]'\"]", ""), ",")
    items = F.when(text.startswith("[") & listed.isNotNull(), listed).otherwise(loose)
    return F.filter(F.transform(items, stripped), lambda x: x != "")


def ordered_digest(cases: Column | str, first: str = "input", second: str = "expected") -> Column:
    """sha256 over the cases of an array in its order; collect with an ordinal and sort before."""
    joined = F.transform(column(cases), lambda x: F.concat(x[first], F.lit("\x1e"), x[second], F.lit("\x1d")))
    return F.sha2(F.array_join(joined, ""), 256)


def comparison_mode(c: Column | str) -> Column:
    given = F.nullif(stripped(column(c)), F.lit(""))
    return F.coalesce(F.try_element_at(literal_map(MODE_ALIASES), given), given, F.lit("token"))


def language(c: Column | str) -> Column:
    given = F.lower(stripped(column(c)))
    return F.coalesce(F.try_element_at(literal_map(LANGUAGE_ALIASES), given), given)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sections(c: Column | str) -> Column:
    """Step to text of a Markdown answer; of two sections of one step the last counts."""
    # Cut before each heading: one pass over the text. What comes before the first is no section, nor is a heading without a line end.
    parts = F.split(F.regexp_replace(column(c), HEADING, "## $1"), HEAD)
    held = F.filter(F.slice(parts, 2, F.size(parts)), lambda x: x.contains("\n"))
    found = F.transform(held, lambda x: F.struct(F.substring(x, 1, 2).alias("k"), x.alias("v")))

    def last_of_each(p: Column) -> Column:
        last = F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"]))
        return F.map_from_entries(F.array_sort(F.transform(last, lambda x: F.struct(x["k"].alias("key"), stripped(F.substr(x["v"], F.locate("\n", x["v"]) + 1)).alias("value")))))

    return bound(found, last_of_each)


def merged_sections(base: Column | str, patch: Column | str) -> Column:
    """Sections of ``base`` with those of ``patch`` over them."""
    b, p = column(base), column(patch)
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(p), k)), p)


def rendered_sections(steps: Column | str) -> Column:
    order = F.filter(F.array(*map(F.lit, STEPS)), lambda s: F.array_contains(F.map_keys(column(steps)), s))
    return F.array_join(F.transform(order, lambda s: F.concat(F.lit("## "), s, F.lit("\n"), F.element_at(column(steps), s))), "\n\n")


def missing_sections(steps: Column | str) -> Column:
    """Steps that are absent or blank."""
    given = column(steps)
    text = lambda s: F.coalesce(F.try_element_at(given, s), F.lit(""))
    return F.filter(F.array(*map(F.lit, STEPS)), lambda s: stripped(text(s)) == "")


def code_block(c: Column | str) -> Column:
    return stripped(F.regexp_extract(column(c), FENCE, 1))


def step_rank(c: Column | str) -> Column:
    """0 to 6 for S1 to S7, 7 for anything else and null."""
    at = F.array_position(F.array(*map(F.lit, STEPS)), column(c))
    return F.coalesce(F.nullif(at, F.lit(0)) - 1, F.lit(7)).cast("int")


def width_bucket_label(c: Column | str, width: int) -> Column:
    """``low-high`` of the bucket, ``unknown`` for null."""
    low = (F.floor(column(c) / width) * width).cast("long")
    return F.when(column(c).isNull(), F.lit("unknown")).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string")))


def value_or_default(c: Column | str, default: object) -> tuple[Column, Column]:
    """The value, or the default where it is null or 0; and which of both it was."""
    given = F.nullif(column(c), F.lit(0).cast("double"))
    return F.coalesce(given, F.lit(default)), F.when(given.isNull(), F.lit("default")).otherwise(F.lit("dataset"))


def candidate_name(kind: Column | str, suffix: Column | str) -> Column:
    tail = F.coalesce(column(suffix), F.lit(""))
    return F.when(tail == "", column(kind)).otherwise(F.concat(column(kind), F.lit("-"), tail))


def candidate_id(pid: Column | str, name: Column | str) -> Column:
    return F.concat(column(pid), F.lit("#"), column(name))


def steps_digest(steps: Column | str) -> Column:
    """sha256 of the seven step texts in order, blank where absent."""
    order = F.array(*map(F.lit, STEPS))
    return F.sha2(F.array_join(F.transform(order, lambda s: F.coalesce(F.try_element_at(column(steps), s), F.lit(""))), "\x1e"), 256)


def error_type(c: Column | str) -> Column:
    """E1 to E8, anything else NONE."""
    given = F.upper(stripped(column(c)))
    return F.when(given.rlike("^E[1-8]$"), given).otherwise(F.lit("NONE"))


def clamped_confidence(c: Column | str) -> Column:
    """A number kept within 0 to 1; 0.5 where there is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(column(c).try_cast("double"), F.lit(0.5))))


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
