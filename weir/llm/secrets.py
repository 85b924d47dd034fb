"""Secret scans: fixed patterns, and zstandard novelty beside sensitive words.

Base kinds are `assign`, `access` and `hex`. The method adds `novel`: a string of 16 or
more characters of the base-64 alphabet that follows a sensitive word within `REACH`
characters and holds letters and digits, whole and to its own end however long it is,
unless base spans cover all of it; one that a base span only runs into is reported
beside that span, and measured by what the span leaves if that is as long as a candidate.
It is measured by
its marginal compressed bytes: what the surrounding text, lower-cased and primed by a
dictionary of common identifiers, needs with the candidate less what it needs without.
Prose, identifiers and repeated strings compress; a random one costs nearly a byte for
each 1.3 characters and is reported from `COST` bytes a character upwards.

Null texts are empty and have no spans. Spans are in code points, end exclusive. Very
long texts are scanned whole, in time that grows with their length. Every row gives one
row, repeated rows too; an empty table gives an empty result; extra columns are ignored,
or kept by redact().
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import map_rows, read_table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"(?:password|passwd|passphrase|secret|token|api_?key|private_?key|credential|bearer|authorization|access_?key|signature)", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
REACH, AROUND, COST, LEVEL = 48, 256, 0.6, 9
IDENTIFIERS = (
    b"password passwd passphrase secret token api_key apikey private_key credential bearer authorization access_key signature "
    b"client_id client_secret session_id user_name database connection string config environment variable example placeholder "
    b"0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ https http www localhost default changeme undefined null true false "
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the fixed patterns."""
    found = []
    if ASSIGN_WORD.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Compressor primed with the identifier dictionary."""

    def __init__(self, identifiers: bytes = IDENTIFIERS, level: int = LEVEL):
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=4 * AROUND, dict_size=len(identifiers), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress

    def cost(self, before: str, candidate: str, after: str) -> float:
        """Marginal compressed bytes for each byte of the candidate."""
        around = (before + after).encode()
        return (len(self.compress(around + candidate.encode())) - len(self.compress(around))) / max(1, len(candidate))


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal intervals of spans, which are in order of starts."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def uncovered(text: str, a: int, b: int, starts: list[int], ends: list[int]) -> str:
    """What intervals leave of text[a:b]."""
    out = []
    for i in range(bisect_right(ends, a), bisect_left(starts, b)):
        out.append(text[a : max(a, starts[i])])
        a = max(a, ends[i])
    return "".join(out) + text[a:b]


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, cost: float = COST) -> list[tuple[int, int, int]]:
    """Spans of the method's own kind: no two overlap, and base spans cover none of them."""
    out, done = [], 0
    starts, ends = merged(taken)
    for word in SENSITIVE.finditer(text):
        at, limit = max(done, word.end()), word.end() + REACH
        while found := CANDIDATE.search(text, at, limit + 16):
            a, b = CANDIDATE.match(text, found.start()).span()
            at = done = b
            rest = uncovered(text, a, b, starts, ends)
            s = rest if len(rest) >= 16 else text[a:b]
            if not rest or not (any(map(str.isdigit, s)) and any(map(str.isalpha, s))):
                continue
            if novelty.cost(text[max(0, a - AROUND) : a], s, text[b : b + AROUND]) >= cost:
                out.append((a, 3, b))
    return out


_NOVELTY: list[Novelty] = []


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans, by start and then kind."""
    if not text:
        return []
    if not _NOVELTY:
        _NOVELTY.append(Novelty())
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, _NOVELTY[0]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of each document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def fn(ids, texts):
        return {"doc_id": ids, "spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in texts]}

    return map_rows(rows, fn, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by `mark`; overlapping spans by one."""
    names = docs.columns
    at = names.index(text_col)

    def fn(*columns):
        texts = []
        for t in columns[at]:
            out, done = [], 0
            for a, _, b in scan(t):
                if a >= done:
                    out += [t[done:a], mark]
                done = max(done, b)
            texts.append(t if not out else "".join(out) + t[done:])
        return dict(zip(names, columns)) | {text_col: texts}

    return map_rows(docs, fn, docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digests and spans of the secrets in every whole text."""
    found = find_secrets(read_table(spark, sf_dir, "documents"))

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
