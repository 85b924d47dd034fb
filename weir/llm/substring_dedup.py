"""Exact removal of repeated token windows by Rabin-Karp hashes.

Every window of 50 words has a Rabin-Karp hash, taken from prefix sums of word hashes in
two bases (128 bits). Shipping each of them would move several times the input, so
consecutive windows travel together as runs: windows whose least 16-word hash (their
anchor) stands at the same place. The anchor is a function of a window's own words, so
equal windows always meet under one anchor. Spark counts runs by the hash of all their
words: a run that also starts in a smaller document is removed whole. Only where one
anchor has runs of different content are single windows hashed and counted, once for
each distinct content. Nothing is left out: each window is judged in its run or alone.
Removed windows merge into maximal intervals, and the text is rebuilt around them.

Null texts have no words. Rows with a null doc_id are neither smaller nor larger than
any; nothing is removed from them or because of them. Rows that share a doc_id do not
remove each other's words. Repeated rows each give a row. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import map_rows, materialize, read_table, text_bytes

WINDOW = 50
ANCHOR = 16
PLACE = 30  # bits of an anchor key that hold the position

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, n.bit_length())
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[which] = have = (out[0], out[1])
    return have


class Rolling:
    """Rabin-Karp hashes of any window of a sequence of word hashes."""

    def __init__(self, words: np.ndarray, which: int):
        up, self.down = _powers(which, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum((words if which == 0 else _mix(words)) * up[: len(words)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def runs(words: list[bytes], window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash and two content hashes of each run."""
    n = len(words)
    if n < window:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    h = word_hashes(words)
    one, two = Rolling(h, 0), Rolling(h, 1)
    at = np.arange(n - k + 1)
    grams = one.of(at, at + k)
    low = np.uint64((1 << PLACE) - 1)
    least = (grams & ~low) | at.astype(np.uint64)
    have, want = 1, window - k + 1
    while have * 2 <= want:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < want:
        least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
    anchor = (least & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    place = anchor[first]
    shape = ((last - first).astype(np.uint64) << np.uint64(32)) | (place - first).astype(np.uint64)
    content = [_mix(x.of(first, last + window) ^ _mix(shape + np.uint64(1))) for x in (one, two)]
    return first, last - first + 1, grams[place].view(np.int64), content[0].view(np.int64), content[1].view(np.int64)


def windows(words: list[bytes], ranges: list[tuple[int, int]], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Start and two hashes of every window in ranges of (first, number)."""
    h = word_hashes(words)
    start = np.unique(np.concatenate([np.arange(a, a + n) for a, n in ranges]))
    return start, *(Rolling(h, i).of(start, start + window).view(np.int64) for i in (0, 1))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_removed, kept_sha256[, kept as the text
    that is left, words joined by one space]."""
    if not 0 < k <= window:
        raise ValueError("the anchor must fit in the window")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")).withColumn("tkey", F.xxhash64("text"))

    def cut(ids, texts, keys):
        out = {x: [] for x in ("doc_id", "tkey", "n_words", "sha", "start", "n", "anchor", "h1", "h2")}
        for doc, text, key in zip(ids, texts, keys):
            words = text.split()
            for x, v in zip(out, (doc, key, len(words), _sha(words), *runs(words, window, k))):
                out[x].append(v)
        return out

    lists = "start array<int>, n array<int>, anchor array<bigint>, h1 array<bigint>, h2 array<bigint>"
    cuts = materialize(map_rows(source, cut, f"doc_id bigint, tkey bigint, n_words bigint, sha string, {lists}"), "runs")
    every = cuts.where("doc_id is not null").select("doc_id", "tkey", F.inline(F.arrays_zip("start", "n", "anchor", "h1", "h2")))
    met = cuts.where("doc_id is not null").select("doc_id", F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    # What is aggregated is stored before it is joined: Spark splits a skewed key of a join
    # only where both sides come straight from an exchange.
    met = materialize(met, "met")
    repeated = materialize(every.join(met, "anchor"), "repeats")

    content = materialize(repeated.groupBy("anchor", "h1", "h2").agg(F.min("doc_id").alias("m")), "content")
    mixed = content.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor", F.lit(True).alias("mixed"))
    mixed = materialize(mixed, "mixed")
    first = content.join(mixed, "anchor", "left")
    marks = materialize(repeated.join(first, ["anchor", "h1", "h2"]).where("doc_id > m or mixed").select("doc_id", "tkey", "start", "n", (F.col("doc_id") > F.col("m")).alias("gone")), "marks")

    asked = marks.where("not gone").groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))

    def alone(ids, keys, texts, ranges):
        out = {x: [] for x in ("doc_id", "tkey", "start", "w1", "w2")}
        for doc, key, text, r in zip(ids, keys, texts, ranges):
            for x, v in zip(out, (doc, key, *windows(text.split(), [(i["start"], i["n"]) for i in r], window))):
                out[x].append(v)
        return out

    hashed = materialize(map_rows(source.join(asked, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "ranges"), alone, "doc_id bigint, tkey bigint, start array<int>, w1 array<bigint>, w2 array<bigint>"), "windows")
    single = hashed.select("doc_id", "tkey", F.inline(F.arrays_zip("start", "w1", "w2")))
    again = single.groupBy("w1", "w2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("w1", "w2", "m")
    again = materialize(again, "again")
    gone = single.join(again, ["w1", "w2"]).where("doc_id > m").select("doc_id", "tkey", F.struct("start", (F.col("start") + window).alias("end")).alias("span"))
    gone = marks.where("gone").select("doc_id", "tkey", F.struct("start", (F.col("start") + F.col("n") + (window - 1)).alias("end")).alias("span")).unionByName(gone)
    spans = gone.groupBy("doc_id", "tkey").agg(F.collect_list("span").alias("spans"))  # of one document

    def rebuild(ids, keys, texts, found):
        out = {x: [] for x in ("doc_id", "tkey", "n_removed", "left", "kept")}
        for doc, key, text, s in zip(ids, keys, texts, found):
            words = text.split()
            left, done = [], 0
            for a, b in merged([(i["start"], i["end"]) for i in s]):
                left += words[done:a]
                done = b
            left += words[done:]
            for x, v in zip(out, (doc, key, len(words) - len(left), _sha(left), b" ".join(left).decode() if with_text else None)):
                out[x].append(v)
        return out

    changed = map_rows(source.join(spans, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "spans"), rebuild, "doc_id bigint, tkey bigint, n_removed bigint, left string, kept string")
    digests = cuts.select("doc_id", "tkey", "n_words", "sha")
    out = digests.join(changed.dropDuplicates(["doc_id", "tkey"]), ["doc_id", "tkey"], "left")
    cols = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("left", "sha").alias("kept_sha256")]
    return out.select(*cols, *([F.col("kept")] if with_text else []))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


#: The contract in SQL for DuckDB: every window of every document by its own hash.
OP4_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT r, doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT r, list(i) AS starts FROM x JOIN f USING (h) WHERE x.doc_id > f.first GROUP BY r),
g AS (SELECT r, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM m),
c AS (SELECT r, unnest(gone) AS i FROM g),
p AS (SELECT r, w[i] AS word, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE r IN (SELECT r FROM m))),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)
"""
