"""Categories and difficulty bins as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column, literal_map, stripped

# ---- Fixed values: categories in order of priority, and what the two tag vocabularies mean. ----
CATEGORIES = ("DP", "Graph", "DataStructure", "BinarySearch", "Greedy", "Simulation")

CONTEST_TAGS = {
    "dp": "DP", "graphs": "Graph", "trees": "Graph", "dfs and similar": "Graph", "shortest paths": "Graph", "dsu": "Graph", "flows": "Graph",
    "graph matchings": "Graph", "2-sat": "Graph", "bipartite matching": "Graph", "strongly connected components": "Graph",
    "topological sort": "Graph", "data structures": "DataStructure", "sqrt decomposition": "DataStructure", "sparse table": "DataStructure",
    "segment tree": "DataStructure", "fenwick": "DataStructure", "disjoint set union": "DataStructure", "binary search": "BinarySearch",
    "ternary search": "BinarySearch", "ternary": "BinarySearch", "greedy": "Greedy", "implementation": "Simulation", "brute force": "Simulation",
    "simulation": "Simulation", "math": "Simulation", "constructive algorithms": "Simulation", "strings": "Simulation", "sortings": "Simulation",
    "number theory": "Simulation", "combinatorics": "Simulation", "geometry": "Simulation", "games": "Simulation", "probabilities": "Simulation",
    "matrices": "Simulation", "bitmasks": "Simulation", "two pointers": "Simulation", "expression parsing": "Simulation", "schedules": "Simulation",
    "chinese remainder theorem": "Simulation", "fft": "Simulation", "meet-in-the-middle": "Simulation", "divide and conquer": "Simulation",
    "hashing": "Simulation", "interactive": "Simulation",
}
TOPIC_TAGS = {
    "dynamic programming": "DP", "graph algorithms": "Graph", "graph traversal": "Graph", "directed graphs": "Graph", "shortest paths": "Graph",
    "paths and circuits": "Graph", "spanning trees": "Graph", "strong connectivity": "Graph", "flows and cuts": "Graph", "tree algorithms": "Graph",
    "graph theory": "Graph", "graph": "Graph", "tree": "Graph", "trees": "Graph", "data structures": "DataStructure",
    "data structure": "DataStructure", "range queries": "DataStructure", "segment trees revisited": "DataStructure",
    "square root algorithms": "DataStructure", "tree queries": "DataStructure", "amortized analysis": "DataStructure",
    "binary search": "BinarySearch", "searching": "BinarySearch", "greedy algorithms": "Greedy", "greedy": "Greedy", "ad-hoc": "Simulation",
    "bit manipulation": "Simulation", "combinatorics": "Simulation", "complete search": "Simulation", "constructive algorithms": "Simulation",
    "divide and conquer": "Simulation", "fundamentals": "Simulation", "game theory": "Simulation", "geometry": "Simulation",
    "implementation": "Simulation", "mathematics": "Simulation", "math": "Simulation", "matrices": "Simulation", "number theory": "Simulation",
    "polynomials and generating functions": "Simulation", "preprocessing": "Simulation", "probability": "Simulation", "sorting": "Simulation",
    "string algorithms": "Simulation", "string": "Simulation", "strings": "Simulation", "sweep line algorithms": "Simulation",
    "simulation": "Simulation", "brute force": "Simulation", "recursion": "Simulation",
}
KEYWORDS = (
    ("DP", r"(?i)\b(dynamic programming|dp\b|knapsack|subsequence|memoiz)"),
    ("Graph", r"(?i)\b(graph|vertices|edges|tree|forest|dfs|bfs|shortest path|cycle)\b"),
    ("BinarySearch", r"(?i)\b(binary search|bisect|monotonic|maximi[sz]e the minimum|minimi[sz]e the maximum)"),
    ("DataStructure", r"(?i)\b(segment tree|fenwick|priority queue|heap|union[- ]find|stack|deque|balanced tree)\b"),
    ("Greedy", r"(?i)\b(greedy|optimally|maximi[sz]e|minimi[sz]e)\b"),
)
RATING_BINS = ((0, 1200, "<1200"), (1200, 1600, "1200-1599"), (1600, 2000, "1600-1999"), (2000, 2400, "2000-2399"), (2400, 100000, ">=2400"))
#: Bin number of a difficulty label.
LABEL_BIN = {"EASY": 0, "MEDIUM": 1, "MEDIUM_HARD": 2, "HARD": 2, "VERY_HARD": 4, "HARDER": 3, "HARDEST": 3}
#: First and last letter code, bin number.
LETTER_BINS = ((7, 9, 1), (10, 12, 2), (13, 16, 3), (17, 28, 4))


def tag_map() -> dict[str, str]:
    """Tag to category; where both vocabularies have a tag, the contest's meaning holds."""
    return {**TOPIC_TAGS, **CONTEST_TAGS}


def tag_category(tag: Column) -> Column:
    return F.try_element_at(literal_map(tag_map()), tag)


def _cleaned(tags: Column | str) -> Column:
    given = F.transform(F.coalesce(column(tags), F.array().cast("array<string>")), lambda t: F.lower(stripped(t)))
    return F.filter(given, lambda t: t.isNotNull() & (t != ""))


def categories_of(*tags: Column | str) -> Column:
    """All categories that any of the tags names, in order of priority."""
    found = F.transform(F.concat(*map(_cleaned, tags)), tag_category)
    return F.array_intersect(F.array(*map(F.lit, CATEGORIES)), F.array_compact(found))


def keyword_guess(c: Column | str) -> Column:
    """Category and matched word of the first keyword pattern; null if none matches."""
    text = column(c)
    return F.coalesce(*(F.when(text.rlike(p), F.struct(F.lit(name).alias("category"), F.lower(F.regexp_extract(text, p, 0)).alias("word"))) for name, p in KEYWORDS))


def assignment(contest_tags: Column | str, topic_tags: Column | str, description: Column | str) -> Column:
    """Category, source and sorted matching tags: from the tags' union, else from keywords, else unclassified."""
    both = F.concat(_cleaned(contest_tags), _cleaned(topic_tags))
    first = F.get(categories_of(contest_tags, topic_tags), F.lit(0))
    own = F.get(categories_of(contest_tags), F.lit(0))
    hits = F.array_sort(F.array_distinct(F.filter(both, lambda t: tag_category(t) == first)))
    guess = keyword_guess(description)
    made = lambda c, s, m: F.struct(c.alias("category"), s.alias("source"), m.alias("matched"))
    return F.coalesce(
        F.when(first.isNotNull(), made(first, F.when(own.eqNullSafe(first), F.lit("cf_tags")).otherwise(F.lit("taco")), hits)),
        F.when(guess.isNotNull(), made(guess["category"], F.lit("heuristic"), F.array(guess["word"]))),
        made(F.lit("unclassified"), F.lit("unclassified"), F.array().cast("array<string>")),
    )


def rated_bin(rating: Column | str, bins=RATING_BINS) -> Column:
    """Half-open bins; null for a null, zero or out-of-range rating."""
    r = F.nullif(column(rating), F.lit(0))
    return F.coalesce(*(F.when((r >= lo) & (r < hi), F.lit(name)) for lo, hi, name in bins))


def pool_bin(rating: Column | str, code: Column | str, bins=RATING_BINS) -> Column:
    """Bin for pool statistics: ratings over all bins are in the last; without a rating the difficulty code tells."""
    r, d = F.nullif(column(rating), F.lit(0)), F.coalesce(column(code), F.lit(0))
    name = lambda i: F.lit(bins[i][2])
    return (
        F.when(r.isNotNull(), F.coalesce(rated_bin(rating, bins), name(-1)))
        .when(d.between(1, 2), name(0))
        .when(d.between(3, 6), name(2))
        .when(d.between(7, 9), name(1))
        .when(d.between(10, 11), name(2))
        .when(d >= 12, name(3))
        .otherwise(F.lit("unknown"))
    )


def sampling_bin(rating: Column | str, label: Column | str, code: Column | str, bins=RATING_BINS) -> Column:
    """Bin and where it came from: rating, else difficulty label, else difficulty code, else unrated."""
    by_label = F.try_element_at(F.create_map(*(F.lit(x) for k, i in LABEL_BIN.items() for x in (k, bins[i][2]))), F.upper(stripped(column(label))))
    d = F.coalesce(column(code), F.lit(0))
    by_code = F.when(d.between(1, 2), F.lit(bins[0][2])).when(d.between(3, 6), F.lit(bins[2][2]))
    for lo, hi, i in LETTER_BINS:
        by_code = by_code.when(d.between(lo, hi), F.lit(bins[i][2]))
    made = lambda b, s: F.when(b.isNotNull(), F.struct(b.alias("bin"), F.lit(s).alias("source")))
    return F.coalesce(made(rated_bin(rating, bins), "cf_rating"), made(by_label, "taco"), made(by_code, "cc_enum"), F.struct(F.lit("unrated").alias("bin"), F.lit("none").alias("source")))
