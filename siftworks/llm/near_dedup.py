"""Near-duplicates by DartMinHash signatures, banding and exact verification.

Each element (a shingle of five words) owns a region of the plane weight x rank as
high as its weight. Darts fall on that plane at places that only the element's hash
decides, one a unit cell on average. A document throws the darts that land inside its
elements' weights and below a rank threshold, about ``k ln k + 2k`` darts in all
whatever its length; each dart hashes to one of ``k`` coordinates, and the dart of the
lowest rank there is the signature's value. Two documents agree on a coordinate with
a probability equal to their (weighted) Jaccard similarity. Where a coordinate gets
no dart, the threshold is doubled, which changes no earlier winner.

From signatures to classes:

1. Texts of equal words collapse into one node.
2. Nodes that agree on all rows of a band share a bucket. Each bucket links its
   members to its hub, the member with most bucket mates overall, so a bucket of n
   members makes n - 1 candidates.
3. Candidates are verified on the whole texts: Jaccard of their shingle sets of at
   least the threshold.
4. Links form components. A hub and the mates of all its buckets are a group; members
   of a group outside its largest component are held against all of its members, in
   blocks: by their signatures first, then by the texts of those that may be near.

Two texts of one bucket are in its hub's group. There they are in one component, or one
of them is held against the other. So no link is lost to the choice of hub; what remains
is the chance that a pair shares no bucket (3e-6 at 0.8) or is ruled out by its
signatures (see ``SIGMAS``), each less above 0.8, and that a shingle's 64-bit hash is
another's.

Nodes, links and components stay in the cluster. Defined results: a text of fewer than
five words is one shingle; texts without words are copies only of equal texts; a null
text is alone; repeated rows are copies; a class is named by its least doc_id; extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, cut, discard, map_texts, shared_path, slices, table, words_of, written
from .graph import components

WORDS = 5
THRESHOLD = 0.8
#: 24 bands of 4: a pair at 0.8 shares no bucket with probability 3e-6.
BANDS, ROWS = 24, 4
#: Strays that a task holds at most, by rows and by bytes of text, and members that it streams past them.
STRAY_BLOCK, BLOCK_BYTES, MEMBER_CHUNK = 1_000, 4 << 20, 5_000
#: Parts of every bucket when its mates are counted into it, and rows of a part when it is joined with its hub.
SALTS, SALT_ROWS = 16, 1_000
#: Rows of a block or chunk where a group has few of them.
FINE = 128
#: Signatures that agree on fewer coordinates than so many deviations below the threshold rule a pair out: at 96
#: coordinates and 0.8, under 58 of them, which a pair at exactly 0.8 has with probability 3e-6.
SIGMAS = 5
#: Text bytes whose darts are thrown at once; a dart takes about 100 bytes while it flies.
SIGNED_BYTES = 2 << 20
#: Distinct words whose hashes a task remembers before it starts anew.
REMEMBERED = 200_000

_U = np.uint64
# Cumulative Poisson(1) chances of at most 0, 1, 2 ... darts in a unit cell.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def dart_minhash(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of uint32 of ``n`` weighted sets.

    ``element`` (uint64 hashes), ``weight`` (positive) and ``owner`` (set number) are
    parallel, with at most one row for each element of a set. A set without elements
    gets zeros.
    """
    out = np.zeros((n, k), np.uint32)
    best = np.full(n * k, np.inf)
    total = np.bincount(owner, weight, minlength=n)
    aim = k * math.log(k) + 2 * k
    limit = np.where(total > 0, aim / np.maximum(total, 1e-300), 0.0)
    base = np.zeros(n)
    todo = total > 0
    flat = out.reshape(-1)
    while todo.any():
        live = todo[owner]
        e, w, o = element[live], weight[live], owner[live]
        # Unit cells: weight cells of each element, times rank cells from those of the last try on.
        first, last = np.floor(base[o]).astype(np.int64), np.ceil(limit[o]).astype(np.int64)
        high, wide = np.ceil(w).astype(np.int64), last - first
        cells = high * wide
        at = np.repeat(np.arange(len(e)), cells)
        inner = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        row, rank = inner // wide[at], first[at] + inner % wide[at]
        h = _mix(e[at] ^ _mix(row.astype(_U) * _U(0x9E3779B97F4A7C15) + _mix(rank.astype(_U) + _U(1))))
        darts = np.searchsorted(_POISSON, _unit(h))
        hit = darts > 0
        at, row, rank, h, darts = at[hit], row[hit], rank[hit], h[hit], darts[hit]
        i = np.repeat(np.arange(len(at)), darts)
        number = np.arange(len(i)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = _mix(h[i] + (number.astype(_U) + _U(1)) * _U(0xD1B54A32D192ED03))
        y = row[i] + _unit(dart)
        dart = _mix(dart)
        x = rank[i] + _unit(dart)
        dart = _mix(dart)
        own = o[at[i]]
        inside = (y < w[at[i]]) & (x < limit[own])
        own, x, dart = own[inside], x[inside], dart[inside]
        slot = own * k + (dart % _U(k)).astype(np.int64)
        np.minimum.at(best, slot, x)
        won = best[slot] == x
        flat[slot[won]] = (dart[won] >> _U(32)).astype(np.uint32)
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        base, limit = np.where(todo, limit, base), np.where(todo, limit * 2, limit)
    return out


class Shingler:
    """Hashes of word shingles, equal in every process; each distinct word is hashed once."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.known = words, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        size = min(self.words, len(h))
        if not size:
            return h
        n = len(h) - size + 1
        out = np.full(n, size, _U)
        for j in range(size):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[j : n + j])
        return out


def content_key(text: str, words: list[bytes]) -> tuple[int, int]:
    """128 bits of the words, or of the text itself where it has none."""
    if words:
        d = xxhash.xxh3_128_intdigest(b" ".join(words))
    else:
        d = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"), seed=1)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(d >> 64), signed(d & ((1 << 64) - 1))


def signatures(docs: DataFrame, k: int = BANDS * ROWS, words: int = WORDS, weighted: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the content key ``h1``, ``h2`` (null for a null text) and the signature (null without words).

    ``weighted`` gives each shingle its count as weight; else each weighs 1 and the
    signature estimates the Jaccard similarity of shingle sets.
    """

    def make():
        shingler = Shingler(words)

        def call(texts, _):
            keys, elements, weights, owners = [], [], [], []
            for i, text in enumerate(texts):
                if text is None:
                    keys.append((None, None))
                    continue
                found = words_of(text)
                keys.append(content_key(text, found))
                e, n = np.unique(shingler.hashes(found), return_counts=True)
                elements.append(e)
                weights.append(n if weighted else np.ones(len(e)))
                owners.append(np.full(len(e), i))
            out: list[bytes | None] = [None] * len(texts)
            if elements:
                owner = np.concatenate(owners)
                got = dart_minhash(np.concatenate(elements).astype(_U), np.concatenate(weights).astype(float), owner, len(texts), k)
                for i in np.unique(owner):
                    out[i] = got[i].astype("<u4").tobytes()
            return {"h1": [a for a, _ in keys], "h2": [b for _, b in keys], "signature": out}

        return call

    return map_texts(docs, make, "h1 long, h2 long, signature binary", keep, slice_bytes=SIGNED_BYTES)


def _buckets(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node) for each band of each node's signature."""
    keys = [F.struct(F.xxhash64(F.lit(b), F.substring("signature", 1 + 4 * rows * b, 4 * rows)).alias("bucket")) for b in range(bands)]
    return nodes.where("signature is not null").select("node", F.explode(F.array(*keys)).alias("k")).select("k.bucket", "node")


class Profile:
    """The shingles of a text, as sorted distinct hashes, with their weights."""

    def __init__(self, text: str, shingler: Shingler, weighted: bool = False) -> None:
        self.hash, n = np.unique(shingler.hashes(words_of(text)), return_counts=True)
        self.weight = n if weighted else None
        self.total = int(n.sum()) if weighted else len(n)

    def similarity(self, other: Profile) -> float:
        """Jaccard of both sets, weighted (least over greatest weights) if the profiles are."""
        if self.weight is None:
            common = len(np.intersect1d(self.hash, other.hash, assume_unique=True))
        else:
            _, i, j = np.intersect1d(self.hash, other.hash, assume_unique=True, return_indices=True)
            common = int(np.minimum(self.weight[i], other.weight[j]).sum())
        return common / max(1, self.total + other.total - common)


def similarities(pairs: DataFrame, texts: DataFrame, size: int = WORDS, weighted: bool = False) -> DataFrame:
    """Jaccard similarity of the shingles of each pair (a, b). ``texts``: node, text."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").sortWithinPartitions("b")

    def run(batches):
        shingler, last, held = Shingler(size), None, None
        for whole in batches:
            for batch in slices(whole, "text_a"):
                found = []
                for b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("b", "text_a", "text_b")), strict=True):
                    if b != last:
                        last, held = b, Profile(tb, shingler, weighted)
                    found.append(Profile(ta, shingler, weighted).similarity(held))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "j"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, j double")


CELL = ["group", "block", "chunk"]


def _dealt(rows: DataFrame, carried: DataFrame, blocks: int = 1, chunks: int = 1) -> DataFrame:
    """Each group's strays against its members, as cells: a block of strays (role 0), then a chunk of members (role 1).

    ``rows``: group, node, root; ``carried``: what goes along with a node. The members of
    a group outside its largest component are its strays; groups of one component have no
    cells. A large group has many cells, each bounded by rows and by the strays' bytes, so
    that none is one task's work. Groups that one cell could hold are dealt over up to so
    many blocks and chunks all the same, which copies their rows.
    """
    size = F.col("size") if "size" in rows.columns else F.lit(0)
    parts = rows.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    sizes = parts.groupBy("group").agg(F.max(F.struct("n", "root", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > top.n")
    some = lambda n, few, most: F.greatest(F.least(F.ceil(n / FINE), F.lit(few)), F.ceil(n / most))
    blocked = F.greatest(some(F.col("n") - F.col("top.n"), blocks, STRAY_BLOCK), F.ceil((F.col("bytes") - F.col("top.bytes")) / BLOCK_BYTES))
    sizes = sizes.select("group", F.col("top.root").alias("main"), blocked.cast("int").alias("blocks"), some(F.col("n"), chunks, MEMBER_CHUNK).cast("int").alias("chunks"))
    rows = rows.join(sizes, "group").join(carried, "node")
    at = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*CELL, "role", "node", "root", *(c for c in carried.columns if c != "node")]
    strays = rows.where("root <> main").withColumns({"role": F.lit(0), "block": at(1, "blocks")}).withColumn("chunk", all_of("chunks"))
    members = rows.withColumns({"role": F.lit(1), "chunk": at(2, "chunks")}).withColumn("block", all_of("blocks"))
    return strays.select(columns).unionByName(members.select(columns)).repartition(*CELL).sortWithinPartitions(*CELL, "role")


def stray_links(placed: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, size: int = WORDS, weighted: bool = False) -> DataFrame:
    """Links between different components of one group that no hub has made.

    ``placed``: group, node, root (component so far); ``nodes``: node, signature. Strays
    are a query set against all members of their group, in blocks. First the signatures
    alone are compared: they tell which nodes are worth an exact comparison, and only the
    texts of those are sent. A task then gives only links that join components, so at
    most as many as it has strays and components.
    """

    def close(signatures: list[bytes], signature: bytes) -> np.ndarray:
        matrix = np.frombuffer(b"".join(signatures), "<u4").reshape(len(signatures), -1)
        least = matrix.shape[1] * (threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / matrix.shape[1]))
        return np.flatnonzero((matrix == np.frombuffer(signature, "<u4")).sum(axis=1) >= least)

    def cells(batches, text=None):
        """(new cell, rows) of one role at a time."""
        now = None
        for whole in batches:
            for batch in slices(whole, text) if text else [whole]:
                for row in zip(*(batch.column(c).to_pylist() for c in [*CELL, "role", "node", "root", "signature", *([text] if text else [])]), strict=True):
                    yield row[:3] != now, row[0], row[3:]
                    now = row[:3]

    def worth(batches):
        held, signed, out = [], [], set()
        for fresh, group, (role, node, root, signature) in cells(batches):
            if fresh:
                held, signed = [], []
            if role == 0:
                held.append((node, root))
                signed.append(signature)
                continue
            others = [(group, held[i][0]) for i in (close(signed, signature) if held else []) if held[i][1] != root]
            if others:
                out.update(others, [(group, node)])
            if len(out) > 100_000:
                yield flagged(out)
                out = set()
        yield flagged(out)

    def flagged(out):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["group", "node"])

    def exact(batches):
        shingler = Shingler(size)
        held, signed, profiles, parent, out = [], [], [], {}, []

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for fresh, _, (role, node, root, signature, text) in cells(batches, "text"):
            if fresh:
                held, signed, profiles, parent = [], [], [], {}
                if out:
                    yield linked(out)
                    out = []
            if role == 0:
                held.append((node, root))
                signed.append(signature)
                profiles.append(Profile(text, shingler, weighted))
                continue
            mine = None
            for i in close(signed, signature) if held else []:
                other, its = held[i]
                if other == node or find(its) == find(root):
                    continue
                mine = mine or Profile(text, shingler, weighted)
                if mine.similarity(profiles[i]) >= threshold - 1e-9:
                    parent[find(its)] = find(root)
                    out.append((other, node))
        yield linked(out)

    def linked(out):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    wanted = _dealt(placed, nodes.select("node", "signature"), 1, 4).mapInArrow(worth, "group long, node long").distinct()
    sized = texts.select("node", F.octet_length("text").alias("size"))
    rows = cut(placed.join(wanted, ["group", "node"], "left_semi").join(sized, "node"))
    return _dealt(rows, texts.join(nodes.select("node", "signature"), "node")).mapInArrow(exact, "a long, b long")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = WORDS, weighted: bool = False
) -> DataFrame:
    """Each document's content key, its class (least doc_id of all near copies) and its node's first doc_id.

    Columns: doc_id, h1, h2, class_id, first_id (least doc_id with equal words), class_node
    (a number that tells classes apart in this result even where ids are null).
    """
    docs = docs.select("doc_id", "text")
    signed = cut(signatures(docs, bands * rows, size, weighted))
    nodes = signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    members = _buckets(nodes, bands, rows)
    shared = members.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    # A bucket may hold a third of all nodes, and neither join can be split where one side is an aggregate: both are salted.
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    live = cut(salted.join(shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["bucket", "salt"]).drop("salt"))
    degree = live.groupBy("node").agg(F.sum("mates").alias("degree"))
    hub = live.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("hub"), F.max("mates").alias("mates"))
    parts = F.ceil(F.col("mates") / SALT_ROWS).cast("int")
    hub = hub.select("bucket", F.col("hub.node").alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    mates = live.select("bucket", "node", F.pmod(F.xxhash64("node"), parts).cast("int").alias("salt"))
    stars = cut(mates.join(hub, ["bucket", "salt"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct())

    needed = nodes.join(live.select("node").distinct(), "node", "left_semi").select("h1", "h2", "first_id", "node")
    # The texts of candidates are read several times, so they are written once and removed at the end.
    place = shared_path(docs.sparkSession, "near-dedup-texts")
    candidate = among(needed, "first_id")  # the texts of the others don't leave the scan
    texts = written(_texts_of(docs.where(candidate(F.col("doc_id"))), needed), "", place)
    near = cut(similarities(stars, texts, size, weighted))
    links = near.where(F.col("j") >= threshold - 1e-9).select("a", "b")
    roots = cut(components(links))

    # Each hub and its mates, in which pairs that the hubs missed lie.
    grouped = stars.select(F.col("b").alias("group"), F.col("a").alias("node"))
    grouped = grouped.unionByName(stars.select(F.col("b").alias("group"), F.col("b").alias("node")).distinct())
    placed = cut(grouped.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    more = cut(stray_links(placed, nodes, texts, threshold, size, weighted))
    discard(docs.sparkSession, place)
    if not more.isEmpty():
        # The components so far are stars already; only what joins them is new.
        roots = cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))

    named = nodes.join(roots, "node", "left").select("h1", "h2", "first_id", F.coalesce("root", "node").alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = named.join(least, "root").select("h1", "h2", "first_id", "class_id", F.col("root").alias("class_node"))
    known = signed.where("h1 is not null").select("doc_id", "h1", "h2").join(classes, ["h1", "h2"])
    alone = signed.where("h1 is null").select("doc_id", "h1", "h2")
    alone = alone.withColumns({"class_id": F.col("doc_id"), "first_id": F.col("doc_id"), "class_node": F.lit(None).cast("long")})
    columns = ["doc_id", "h1", "h2", "class_id", "first_id", "class_node"]
    return known.select(*columns).unionByName(alone.select(*columns))


def deduplicated(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The rows of least doc_id of each class, in full; null texts all stay.

    Of several rows of that id and of equal words the least stays, by the columns in ``keep`` in order.

    Rows find their class by doc_id and content key, so two texts under one doc_id are told apart. Rows whose
    id is in no class of several rows stay as they are read; only the others are looked at again.
    """
    found = cut(near_duplicates(docs))
    several = found.where("h1 is not null").groupBy("class_node").agg(F.count("*").alias("n")).where("n > 1")
    copied = among(found.join(several, "class_node", "left_semi").select("doc_id"), "doc_id")(F.col("doc_id"))
    lone, docs = docs.where(~copied).select(*keep), docs.where(copied)
    classed = found.where("h1 is not null and class_id <=> first_id and doc_id <=> class_id")
    # One first row for each class: of several contents under one doc_id the least key stays.
    stay = classed.groupBy("class_node").agg(F.first("class_id").alias("class_id"), F.min(F.struct("h1", "h2")).alias("k"), F.count("*").alias("_rows"))
    stay = cut(stay.select("class_id", F.col("k.h1").alias("_h1"), F.col("k.h2").alias("_h2"), "_rows"))
    rows = keyed(docs, tuple(c for c in keep if c != "text"))
    match = rows.doc_id.eqNullSafe(stay.class_id) & (rows.h1 == stay["_h1"]) & (rows.h2 == stay["_h2"])
    first = rows.join(stay, match)
    single = first.where("_rows = 1").select(*keep)
    repeated = first.where("_rows > 1").groupBy("class_id", "_h1", "_h2").agg(F.min(F.struct(*keep)).alias("_row")).select("_row.*")
    return lone.unionByName(single).unionByName(repeated).unionByName(rows.where("h1 is null").select(*keep))


def keyed(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Rows with their content key and text."""

    def make():
        def call(texts, batch):
            keys = [(None, None) if t is None else content_key(t, words_of(t)) for t in texts]
            return {"h1": [a for a, _ in keys], "h2": [b for _, b in keys], "_text": batch.column("text")}

        return call

    return map_texts(docs, make, "h1 long, h2 long, _text string", keep).withColumnRenamed("_text", "text")


def _texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, text) of the needed nodes: the row with the node's first doc_id, once."""
    rows = keyed(docs, ("doc_id",)).where("h1 is not null")
    match = (rows.h1 == needed.h1) & (rows.h2 == needed.h2) & rows.doc_id.eqNullSafe(needed.first_id)
    return rows.join(needed, match).select("node", "text").dropDuplicates(["node"])


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id")
