"""Secret scans: fixed patterns, then dictionary-primed compression novelty.

The base patterns always count. The method looks at the other candidates: strings
of key-like characters that stand in a sensitive context (a word such as ``key``,
``auth`` or ``credential`` shortly before them). A zstandard dictionary made of
code identifiers and common words primes the compressor; a candidate's marginal
size is what it adds to its compressed surroundings, in which its copies are blank.
Ordinary words and identifiers cost little more than a reference; random strings stay
near their own entropy and are reported with kind ``novel``.

Defined results: null and empty texts have no spans; spans of one kind never
overlap; a candidate that touches a base span is that base span's already; ties
in start go by kind order; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import accumulate, pairwise

import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Order of kinds among spans with the same start.
KINDS = ("assign", "access", "hex", "novel")

#: Characters of the shortest candidate, and of the shortest stretch that counts as its copy.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Words that make what follows them sensitive, also within longer words (``api_key``, ``authorization``).
SENSITIVE = ("key", "auth", "password", "passwd", "pwd", "passphrase", "secret", "token", "credential", "private", "bearer", "signature", "client_id")
#: All of a private key is sensitive, and what adjoins something sensitive with at most a line end between.
PRIVATE = re.compile(r"BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY[A-Z ]{0,40}-----")
ADJOINING = re.compile(r"(?!.*\n\s*\n)\W{0,48}", re.S)
#: A sensitive word counts within so many characters before the candidate.
REACH = 48
#: Characters around a candidate that count as its surroundings.
AROUND = 160
#: A candidate is novel if it costs at least this share of the bits that a random string over its own alphabet has.
#: Where the surroundings have coded that alphabet already, a random string costs little more than those bits.
NOVEL_SHARE = 0.75
#: A candidate without a digit may be words that the primer lacks; its letter pairs cost at least so many bits each
#: by those of the primer. Random letters: 5.4, 4.6 or more for 99 of 100 strings of 16; half of the identifiers: under 3.8.
PAIR_BITS = 4.6
#: Alphabets from the smallest, by what a candidate consists of, and their bits for each character.
ALPHABETS = tuple((re.compile(p), math.log2(n)) for p, n in (("[0-9A-F=-]+|[0-9a-f=-]+", 16), ("[^A-Za-z]+|[0-9A-Z=_-]+|[0-9a-z=_-]+", 36), ("[0-9A-Za-z=_-]+", 62), (".+", 64)))

#: Identifiers and plain words that prime the compressor (fixed values).
IDENTIFIERS = """
import from return def class self None True False const let var function public private static void int string
password passwd secret token api_key apikey access_key client_id client_secret authorization bearer credential
username user_name config settings environment variable example placeholder changeme localhost 127.0.0.1
http https www com org net html json yaml xml utf-8 application content-type multipart boundary
createElement getElementById addEventListener setTimeout console.log toString hasOwnProperty prototype
std vector iterator begin end size push_back unsigned long double float boolean char byte array list dict map
SELECT FROM WHERE INSERT UPDATE DELETE CREATE TABLE PRIMARY KEY NOT NULL DEFAULT VALUES GROUP ORDER
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef xxxxxxxxxxxxxxxx ----------------
________________ ================ 0000000000000000 1111111111111111 aaaaaaaaaaaaaaaa ................
release build version production staging development test report final draft module package service server client
profile setting settings_ variable _variable_name long_name super_long counter index_ total value_ values_ number_ handler
manager controller factory provider repository database connection request response message session context
document template component element container resource 2020 2021 2022 2023 2024 2025 2026 -01- -02- -production- -release-
the and that with this from have which will there their about would these other into could than then
"""


@lru_cache(1)
def _compressor() -> zstandard.ZstdCompressor:
    """Whole surroundings fit one block; the raw dictionary is at most a few KB."""
    primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bits(before: str, candidate: str, after: str) -> float:
    """Compressed bits that each character of the candidate adds to its surroundings:
    the primed size with the candidate less the primed size without it.
    """
    size = lambda s: len(_compressor().compress(s.encode("utf-8", "surrogatepass")))
    return 8 * (size(before + candidate + after) - size(before + after)) / max(1, len(candidate))


@lru_cache(1)
def _pairs() -> tuple[Counter, Counter]:
    words = re.findall("[a-z]+", re.sub("(?i)abcdefghijklmnopqrstuvwxyz", "", IDENTIFIERS).lower())
    return Counter(p + q for w in words for p, q in pairwise(w)), Counter(p for w in words for p in w[:-1])


def pair_bits(candidate: str) -> float:
    """Bits of a letter after another, averaged, by how often letters follow each other in the primer."""
    pairs, first = _pairs()
    found = [math.log2((first[p] + 13) / (pairs[p + q] + 0.5)) for p, q in pairwise(candidate.lower()) if p.isalpha() and q.isalpha()]
    return sum(found) / max(1, len(found))


#: A candidate of more characters is searched for the stretches of its surroundings, instead of listing its own.
LONG = 4096


def without_copies(around: str, candidate: str) -> str:
    """``around`` with spaces for what it shares with the candidate; a copy must not make the candidate cheap."""
    places = range(len(around) - LEAST + 1)
    if len(candidate) > LONG:
        shared = [i for i in places if around[i : i + LEAST] in candidate]
    else:
        parts = {candidate[i : i + LEAST] for i in range(len(candidate) - LEAST + 1)}
        shared = [i for i in places if around[i : i + LEAST] in parts]
    out = list(around)
    for i in shared:
        out[i : i + LEAST] = " " * LEAST
    return "".join(out)


def surroundings(text: str, a: int, b: int) -> tuple[str, str]:
    """What stands before and after a candidate; copies that the edges cut are blanked with the others."""
    before = without_copies(text[max(0, a - AROUND - LEAST + 1) : a], text[a:b])
    return before[-AROUND:], without_copies(text[b : b + AROUND + LEAST - 1], text[a:b])[:AROUND]


def alphabet_bits(candidate: str) -> float:
    return next(bits for p, bits in ALPHABETS if p.fullmatch(candidate))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def private_blocks(text: str) -> list[tuple[int, int]]:
    """From the head of each private key to its end; a head inside another block opens none."""
    out, at = [], 0
    while m := PRIVATE.search(text, at):
        at = text.find("-----END", m.end())
        if at < 0:
            break
        out.append((m.end(), at))
    return out


class Cover:
    """Whether a stretch of text touches any of some spans, in the logarithm of their number."""

    def __init__(self, spans: list[tuple[int, int]]):
        ordered = sorted(spans)
        self.begins = [a for a, _ in ordered]
        self.reach = list(accumulate((b for _, b in ordered), max))  # the furthest end so far

    def touches(self, a: int, b: int) -> bool:
        before = bisect_left(self.begins, b)
        return before > 0 and self.reach[before - 1] > a


def novel_spans(text: str, taken: list[tuple[int, int, str]], share: float = NOVEL_SHARE) -> list[tuple[int, int, str]]:
    """Candidates in a sensitive context whose marginal compressed size is near that of a random string of their alphabet.

    Time follows the text: spans and key blocks are looked up in sorted lists, and what is compressed beside a candidate is bounded.
    """
    low = text.lower()
    if len(low) != len(text):  # a few letters change length; positions must hold
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not any(k in low for k in SENSITIVE):
        return []
    blocks, held = Cover(private_blocks(text)), Cover([(x, y) for x, y, _ in taken])
    out, last = [], -1  # end of the last candidate in a sensitive context
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # NAME=value without spaces is one candidate; its name is context of the value.
        at = a + name if (name := m[0].rstrip("=").find("=") + 1) and len(m[0]) - name >= LEAST else a
        if not (
            any(k in low[max(0, a - REACH) : max(a, at)] for k in SENSITIVE)
            or blocks.touches(a, a + 1)
            or (last >= 0 and a - last <= REACH and ADJOINING.fullmatch(text, last, a))
        ):
            continue
        last = b
        s = text[at:b]
        if held.touches(a, b):
            continue
        if not any(c.isdigit() for c in s) and pair_bits(s) < PAIR_BITS:
            continue
        before, after = surroundings(text, at, b)
        if marginal_bits(before, s, after) >= share * alphabet_bits(s):
            out.append((a, b, "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), share: float = NOVEL_SHARE, redact: str | None = None) -> DataFrame:
    """Spans of each document; with ``redact``, also the text with each span replaced by it (``clean_text``)."""

    def make():
        def call(texts, _):
            n = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "clean_text")}
            for text in texts:
                base = base_spans(text) if text else []
                spans = [*base, *novel_spans(text, base, share)] if text else []
                for k in KINDS:
                    n[f"n_{k}"].append(sum(x[2] == k for x in spans))
                n["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                n["spans"].append(joined(spans))
                if redact is not None:
                    n["clean_text"].append(redacted(text, spans, redact) if spans else text)
            return n

        return call

    columns = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return map_texts(docs, make, columns + (", clean_text string" if redact is not None else ""), keep)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op7_compression_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
