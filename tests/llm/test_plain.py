"""Columns that SQL can express against DuckDB, and measures against plain makings of their definitions."""

from __future__ import annotations

import math
import os
import random
import re

import duckdb
import pytest
import zstandard

from siftworks.llm import quality_rules, secret_scan, sharding, toxicity
from siftworks.llm.common import table

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return c


def same(duck, sql, rows):
    want = duck.sql(sql)
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in want.columns) for r in rows)


RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT x.doc_id, unnest(range(i, i + 8)) AS p FROM x JOIN (SELECT doc_id, win FROM x GROUP BY ALL HAVING count(*) > 1) y ON x.doc_id = y.doc_id AND x.win = y.win) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce((SELECT sum(n - 1) FROM l WHERE l.doc_id = d.doc_id), 0)::BIGINT AS n_dup_lines, coalesce((SELECT n FROM r WHERE r.doc_id = d.doc_id), 0)::BIGINT AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce((SELECT n FROM r WHERE r.doc_id = d.doc_id), 0) > 30 * len(w) AS base_failed FROM d"""


@needs_data
def test_rules_equal_sql(spark, duck):
    same(duck, RULES_SQL, quality_rules.op6_divergence(spark, DATA).collect())


SECRETS_SQL = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


@needs_data
def test_secret_counts_equal_sql(spark, duck):
    rows = secret_scan.op7_compression_novelty(spark, DATA).collect()
    same(duck, SECRETS_SQL, rows)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) > 10


@needs_data
def test_sizes_equal_sql(spark, duck):
    rows = sharding.op8_virtual_slots(spark, DATA).collect()
    same(duck, "SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size FROM documents", rows)
    sums = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 0.01 * sum(sums)


def plain_bits(before, candidate, after):
    """What the candidate adds to its surroundings, whose copies of it are blank, compressed behind the primer."""
    primer = zstandard.ZstdCompressionDict(secret_scan.IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda s: len(zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False).compress(s.encode()))
    return 8 * (size(before + candidate + after) - size(before + after)) / len(candidate)


def blank(around, candidate, least=16):
    covered = {j for i in range(len(around) - least + 1) if around[i : i + least] in candidate for j in range(i, i + least)}
    return "".join(" " if i in covered else c for i, c in enumerate(around))


@needs_data
def test_novelty_equals_plain_making(spark):
    """Every candidate in a sensitive context of all documents, its share of a random string's bits recomputed."""
    texts = [r["text"] for r in table(spark, DATA, "documents").select("text").collect() if r["text"]]
    draw, found, judged = random.Random(3), 0, 0
    texts += [f"{t[:300]} api credential: {''.join(draw.choices('abcdefghijkmnpqrstuvwxyzABCDEFGH23456789', k=32))} {t[300:]}" for t in texts[:100]]
    for text in texts:
        base = secret_scan.base_spans(text)
        got = {(a, b) for a, b, _ in secret_scan.novel_spans(text, base)}
        for a, b in got:
            at = max(a, a + text[a:b].rstrip("=").find("=") + 1) if len(text[a:b]) - (text[a:b].rstrip("=").find("=") + 1) >= 16 else a
            s = text[at:b]
            kinds = 16 if re.fullmatch("[0-9A-F=-]+|[0-9a-f=-]+", s) else 36 if re.fullmatch("[^A-Za-z]+|[0-9A-Z=_-]+|[0-9a-z=_-]+", s) else 62 if re.fullmatch("[0-9A-Za-z=_-]+", s) else 64
            before, after = blank(text[max(0, at - 175) : at], s)[-160:], blank(text[b : b + 175], s)[:160]
            assert plain_bits(before, s, after) >= 0.75 * math.log2(kinds)
            assert not any(x < b and a < y for x, y, _ in base)
            found += 1
        # A candidate that was left out is covered by a base span, costs little, or stands in no sensitive context.
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
            a, b = m.span()
            near = text[max(0, a - 48) : a].lower()
            if (a, b) not in got and any(k in near for k in secret_scan.SENSITIVE) and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and "=" not in m[0] and not any(x < b and a < y for x, y, _ in base):
                judged += 1
                bits = plain_bits(blank(text[max(0, a - 175) : a], m[0])[-160:], m[0], blank(text[b : b + 175], m[0])[:160])
                assert bits < 0.75 * 6
    assert found >= 95


def test_toxic_features_equal_plain_counts():
    """Tiers, hits, weights and nearness word by word."""
    draw = random.Random(9)
    lexicon = {"grunk": (2.0, 3), "snar*": (1.5, 20), "fleeb": (1.2, 100), "snarzo": (3.0, 70)}
    entry = lambda w: min((lexicon[k] for k in (w, w[:4] + "*" if len(w) > 4 else w) if k in lexicon), key=lambda e: e[1], default=None)
    for _ in range(50):
        words = draw.choices(["grunk", "snarzo", "snarl", "snar", "fleeb", "you", "your", "plain", "words", "go"], k=draw.randint(1, 60))
        got = dict(zip(toxicity.FEATURES, toxicity.features(" ".join(words), lexicon), strict=True))
        hits = [(i, entry(w)) for i, w in enumerate(words) if entry(w)]
        n = len(words)
        for top in toxicity.TIERS:
            assert got[f"tier_{top}"] == pytest.approx(100 * sum(e[1] < top for _, e in hits) / n)
        assert got["hits"] == len(hits)
        distinct = {w: entry(w)[0] for w in words if entry(w)}
        assert got["weight"] == pytest.approx(sum(distinct.values())) and got["strongest"] == max(distinct.values(), default=0)
        person = [i for i, w in enumerate(words) if w in ("you", "your")]
        assert got["near_second_person"] == pytest.approx(100 * sum(any(abs(i - p) <= 5 for p in person) for i, _ in hits) / n)
        assert got["second_person"] == pytest.approx(100 * len(person) / n)
