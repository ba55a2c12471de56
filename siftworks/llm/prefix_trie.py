"""Prefix tries of conversations: which turns conversations share, and what keeping them once would save.

Every turn becomes a digest of its role and text and the length of its text; texts travel no
further. Equal conversations are combined before anything else, so a trie has one path for
each different one, with its copies counted. Paths are dealt by their first
turn: all that begin alike form a subtrie, and hashed buckets of subtries go to ``applyInPandas``,
which makes tries of dictionaries and adds up children before their parents, without recursion.

A subtrie of more than ``limit`` turns is dealt again by the next turn after the longest prefix that all
of it shares, and so on. The nodes of that prefix are worked out from the tops of the parts, by
aggregations in the cluster.

The digest of the conversations that end in a node is a hash of sorted ids. Ids are sorted by ranges and
joined to pieces where they lie, and one task per node hashes its pieces as they come.

Defined results: turns are ordered by turn, null first, then by digest; a null role or text is empty; repeated rows are turns
of their own; rows of a null conversation id belong to no conversation; a conversation without turns ends at the
root; an empty table gives an empty result; columns other than the four are not read. A conversation is one row of
at most about 30 million turns (60 bytes each), whatever its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Turns of paths that one subtrie has at most, unless they are one path. A bucket has half as many on average; one with eight
#: times that takes about 250 MB of its task.
LIMIT = 100_000
#: Hexadecimal digits of a digest: 128 bits.
DIGITS = 32
#: Characters of joined ids that are hashed at a time.
PIECE = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = tuple(f.split()[0] for f in NODE.split(", "))


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGITS)


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``: its turns in order, each a digest and the code points of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "chars")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["digest"], x["chars"])).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 100, parts: int = 6) -> DataFrame:
    """Every conversation with its first ``crc32(conv_id) % parts`` turns taken from the first of its family of ids."""
    conversations = cut(conversations)
    heads = conversations.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, parts - 1).alias("_head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(parts)).cast("int")
    rows = conversations.select("conv_id", "turns", h.alias("_h"), (F.col("conv_id") - F.col("conv_id") % family).alias("_base"))
    head = F.coalesce(F.slice("_head", 1, F.col("_h")), F.slice("turns", 1, F.lit(0)))
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    # At most 199 conversations have one base, and a head is a few digests.
    return rows.join(heads, "_base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id): ids of a key joined to pieces, each with its least id."""
    key, ids, size = None, [], 0

    def piece():
        return pa.RecordBatch.from_pydict({"key": [key], "begin": pa.array([ids[0]], pa.int64()), "piece": [",".join(map(str, ids))]})

    for batch in batches:
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (k != key or size >= PIECE):
                yield piece()
                ids, size = [], 0
            key = k
            ids.append(i)
            size += 20
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, begin, piece): SHA-256 of each key's pieces, which are read one by one."""
    key, held = None, None
    for batch in batches:
        for k, p in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if k != key and held is not None:
                yield pa.RecordBatch.from_pydict({"key": [key], "ends": [held.hexdigest()]})
                held = None
            if held is None:
                key, held = k, hashlib.sha256(p.encode())
            else:
                held.update(b"," + p.encode())
    if held is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends": [held.hexdigest()]})


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """Each different conversation once: ``path`` (digests), ``chars``, ``n`` copies, ``least`` id, ``ends``: hash of the copies' sorted ids."""
    digests, chars = F.transform("turns", lambda x: x["digest"]), F.transform("turns", lambda x: x["chars"])
    rows = cut(conversations.select("conv_id", _digest(F.array_join(digests, "")).alias("key"), F.struct(digests.alias("path"), chars.alias("chars")).alias("p")))
    paths = cut(rows.groupBy("key").agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")))
    copies = rows.select("key", "conv_id").join(paths.where("n > 1").select("key"), "key", "left_semi")
    pieces = copies.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key string, begin long, piece string")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "begin").mapInArrow(_hashed, "key string, ends string")
    ends = F.coalesce("ends", F.sha2(F.col("least").cast("string"), 256))
    return paths.join(hashes, "key", "left").select("p.path", "p.chars", "n", "least", ends.alias("ends"))


def _group(depth: Column) -> Column:
    """Name of the subtrie that a path belongs to below a node of ``depth``."""
    return _digest(F.array_join(F.slice("path", 1, depth + 1), ""))


def _shared_length(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def divided(paths: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Paths with the subtrie they fall in (``g``, below depth ``p``, part of ``up``), the subtries that were divided, round by
    round, and the paths that end where one was divided."""
    open_ = cut(paths.where(F.size("path") > 0).select("*", F.lit(0).alias("p"), _group(F.lit(0)).alias("g"), F.lit(None).cast("string").alias("up")))
    done, spans, ended = [], [], []
    while True:
        sizes = open_.groupBy("g").agg(F.sum(F.size("path") - F.col("p")).alias("turns"), F.count(F.lit(1)).alias("paths"))
        over = cut(sizes.where((F.col("turns") > limit) & (F.col("paths") > 1)).select("g"))
        if over.isEmpty():
            return reduce(DataFrame.unionByName, [*done, open_]), spans, ended
        big = open_.join(over, "g", "left_semi")
        least, most = F.min(F.struct("path", "chars")), F.max("path")  # what the two share, all share
        span = big.groupBy("g", "p", "up").agg(least.alias("a"), most.alias("b")).select("g", "p", "up", _shared_length(F.col("a.path"), F.col("b")).alias("q"), F.col("a.chars").alias("chars"))
        span = cut(span.select("g", "p", "up", "q", F.slice("chars", F.col("p") + 1, F.col("q") - F.col("p")).alias("chars")))
        done.append(open_.join(over, "g", "left_anti"))
        deeper = cut(big.drop("p", "up").join(span.select("g", "q"), "g").select("path", "chars", "n", "least", "ends", F.col("q").alias("p"), _group(F.col("q")).alias("next"), F.col("g").alias("up")))
        ended.append(deeper.where("size(path) = p").select("up", "n", "least", "ends"))
        spans.append(span)
        open_ = deeper.where("size(path) > p").withColumnRenamed("next", "g")


def subtries(frame: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the subtries in a bucket. Dictionaries point to children; a child comes after its parent, so
    walking back from the last adds up every subtree before its parent needs it."""
    kids, parent, depth, chars, n, least, ends, tops = [], [], [], [], [], [], [], {}

    def node(above: int, at: int, length: int) -> int:
        kids.append({})
        for column, value in ((parent, above), (depth, at), (chars, length), (n, 0), (least, None), (ends, NOTHING)):
            column.append(value)
        return len(kids) - 1

    columns = (frame[c] for c in ("path", "chars", "n", "least", "ends", "p", "g", "up"))
    for path, lengths, copies, first, end, p, g, up in zip(*columns, strict=True):
        if g not in tops:
            tops[g] = (node(-1, p + 1, int(lengths[p])), up)
        at = tops[g][0]
        for i in range(p, len(path)):
            if i > p:
                below = kids[at].get(path[i])
                if below is None:
                    below = kids[at][path[i]] = node(at, i + 1, int(lengths[i]))
                at = below
            n[at] += copies
            least[at] = first if least[at] is None else min(first, least[at])
        ends[at] = end
    leaves, saved = [0 if k else 1 for k in kids], [(c - 1) * length for c, length in zip(n, chars, strict=True)]
    for i in range(len(kids) - 1, -1, -1):
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    out = pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": pd.array([least[x] if x >= 0 else None for x in parent], "Int64")})
    out = out.assign(n_convs=n, n_children=[len(k) for k in kids], n_leaves=leaves, saved_tokens=saved, ends_sha256=ends, g=None, up=None)
    at = [i for i, _ in tops.values()]
    out["g"], out["up"] = out["g"].astype(object), out["up"].astype(object)
    out.loc[at, "g"], out.loc[at, "up"] = list(tops), [up for _, up in tops.values()]
    return out


_ADDED = (F.sum, "n_convs"), (F.min, "conv_id"), (F.sum, "n_leaves"), (F.sum, "saved_tokens")


def _summed(tops: DataFrame) -> DataFrame:
    """What the tops below a node add to it, by ``up``."""
    return tops.groupBy("up").agg(*(f(c).alias(c) for f, c in _ADDED), F.count(F.lit(1)).alias("n_children"))


def _prefix_nodes(span: DataFrame, below: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes of the prefixes that divided subtries share, from the tops of their parts. The topmost has ``g`` and ``up``."""
    both = span.join(_summed(below).withColumnRenamed("up", "g"), "g").join(ended.select(F.col("up").alias("g"), "n", "least", "ends"), "g", "left")
    n = F.col("n_convs") + F.coalesce("n", F.lit(0))
    rows = both.select("g", "p", "up", "q", "chars", F.least("conv_id", "least").alias("conv_id"), n.alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends", F.explode(F.sequence(F.col("p") + 1, F.col("q"))).alias("depth"))
    top, last = F.col("depth") == F.col("p") + 1, F.col("depth") == F.col("q")
    under = F.aggregate(F.slice("chars", F.col("depth") - F.col("p"), F.size("chars")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(~top, F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * under).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
        F.when(top, F.col("g")).alias("g"),
        F.when(top, F.col("up")).alias("up"),
    )


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of all ``conversations`` (``conv_id``, ``turns``: digest and chars)."""
    spark = conversations.sparkSession
    paths = cut(distinct_paths(conversations))
    parts, spans, ended = divided(paths, limit)
    turns = parts.agg(F.sum(F.size("path") - F.col("p"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * -(-turns // limit))
    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    nodes = [cut(bucketed.groupBy("bucket").applyInPandas(lambda frame: subtries(frame), NODE + ", g string, up string"))]
    tops = [nodes[0].where("g IS NOT NULL")]
    for span, own in zip(reversed(spans), reversed(ended), strict=True):
        # The parts of this round's subtries are tops of tries, or were divided in the next round.
        nodes.append(cut(_prefix_nodes(span, tops[0].where("up IS NOT NULL").unionByName(nodes[-1].where("g IS NOT NULL")) if len(nodes) > 1 else tops[0], own)))
        tops.append(nodes[-1].where("g IS NOT NULL"))
    first = reduce(DataFrame.unionByName, tops)
    kids = first.where("up IS NULL").agg(*(f(c).alias(c) for f, c in _ADDED), F.count(F.lit(1)).alias("n_children")).first()
    bare = paths.where(F.size("path") == 0).first()  # there is one at most
    n = (kids["n_convs"] or 0) + (bare["n"] if bare else 0)
    if not n:
        return spark.createDataFrame([], NODE)
    root_id = min(x for x in (kids["conv_id"], bare["least"] if bare else None) if x is not None)
    root = (root_id, 0, None, n, kids["n_children"], kids["n_leaves"] or 1, kids["saved_tokens"] or 0, bare["ends"] if bare else NOTHING)
    every = reduce(DataFrame.unionByName, nodes)
    below_root = every.where("up IS NULL").withColumn("parent_conv_id", F.when(F.col("g").isNull(), F.col("parent_conv_id")).otherwise(root_id))
    out = spark.createDataFrame([root], NODE).unionByName(below_root.select(*COLUMNS))
    if spans:
        above = first.select(F.col("g").alias("up"), F.col("conv_id").alias("_above")).join(reduce(DataFrame.unionByName, spans).select(F.col("g").alias("up")), "up", "left_semi")
        out = out.unionByName(every.where("up IS NOT NULL").join(above, "up").withColumn("parent_conv_id", F.col("_above")).select(*COLUMNS))
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(conversations_of(table(spark, sf_dir, "conversations"))))


#: DuckDB: every prefix of every conversation as text. CRC-32 is worked out bit by bit: -1 stands for a shift.
OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:{DIGITS}] AS digest, length(coalesce(text, ''))::BIGINT AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'d': digest, 'n': chars}} ORDER BY turn NULLS FIRST, digest) AS p FROM t GROUP BY conv_id),
h AS (SELECT conv_id, p, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295) % 6 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.p, [])[1:h.h], h.p[h.h + 1:]) AS p FROM h LEFT JOIN c b ON b.conv_id = h.base),
x AS (SELECT conv_id, d, len(p) = d AS ends, array_to_string(list_transform(p[1:d], lambda z: z.d), '') AS k, CASE WHEN d = 0 THEN 0 ELSE p[d].n END AS chars
  FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM x GROUP BY k, d),
u AS (SELECT substr(k, 1, greatest(d - 1, 0) * {DIGITS}) AS up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
s AS (SELECT substr(n.k, 1, j * {DIGITS}) AS k, sum(own) AS saved, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM n) n LEFT JOIN u ON u.up = n.k GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN u ON u.up = n.k LEFT JOIN n a ON n.d > 0 AND a.k = substr(n.k, 1, (n.d - 1) * {DIGITS})
"""
