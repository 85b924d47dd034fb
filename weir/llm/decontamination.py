"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased in A-Z; shingles are five words, or as many as the item has if
fewer. For every item, windows of the item's own number of shingles slide over every
whole document, wherever at least one of their shingles occurs in an item of that size
(without one the similarity is zero). A window's 64-bit fingerprint is looked up in a
multi-index: four tables by blocks of 16 bits. For each block the Hamming ball of radius
4 is enumerated and its items fetched; fingerprints within `RADIUS` = 19 bits differ in
at most 4 bits of some block (else 4 x 5 = 20 differ), so none of them is missed. Those
farther apart are: at a similarity of 0.8 fingerprints differ in 9.7 bits on average with
a deviation of 2.9, so a window beyond 19 bits is one in some thousands. Candidates are
verified by the weighted-shingle similarity, the sum of the smaller counts over the sum
of the larger; 0.8 or more is a hit. Of overlapping hits of one item the best stays.

Items are read in blocks of at most `BLOCK_ITEMS` items and `BLOCK_BYTES` bytes, one
pass over the documents for each block, so what is sent to executors has a bound. Items
of one text are sought once, and their ids joined to what was found.

Null and empty texts and items have no shingles and no hits. Repeated items are reported
each, and so are repeated documents. Very long texts are searched whole. An empty table of
documents gives an empty result, an empty benchmark no hits. Extra columns are ignored,
or kept by clean_documents().
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import map_rows, materialize, read_table, text_bytes
from weir.llm.simhash import gram_hashes, majority

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
BLOCKS, WIDTH = 4, 16
REMEMBERED = 1 << 22  # item places that an index keeps of the balls it fetched
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8_000_000
BITS = 1 << 20


def masks(radius: int, width: int = WIDTH) -> np.ndarray:
    """All values of a block with at most radius bits set."""
    every = np.arange(1 << width, dtype=np.uint64)
    return every[np.bitwise_count(every) <= radius]


class Sized:
    """The items of one number of shingles, and the multi-index of their fingerprints."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray]], radius: int = RADIUS):
        self.size, self.radius = size, radius
        self.ids = [i for i, _ in items]
        self.counts = [Counter(h.tolist()) for _, h in items]
        self.prints = np.array([majority(h) for _, h in items], np.uint64)
        # Blocks all farther than their radius would add up to more than the whole radius.
        self.radii = [(radius + 1 + b) // BLOCKS - 1 for b in range(BLOCKS)]
        self.tables = []
        for b in range(BLOCKS):
            values = self.block(self.prints, b)
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], order.astype(np.int32)))
        self.fetched: list[dict[int, np.ndarray]] = [{} for _ in range(BLOCKS)]
        self.kept = 0

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(WIDTH * b)) & np.uint64((1 << WIDTH) - 1)

    def fetch(self, b: int, value: int, ball: np.ndarray) -> np.ndarray:
        """The items whose block lies in the ball about a value."""
        found = self.fetched[b].get(value)
        if found is None:
            values, items = self.tables[b]
            near = ball ^ np.uint64(value)
            first, last = np.searchsorted(values, near), np.searchsorted(values, near, side="right")
            some = np.flatnonzero(last > first)
            found = np.concatenate([items[x:y] for x, y in zip(first[some].tolist(), last[some].tolist())]) if len(some) else items[:0]
            if self.kept > REMEMBERED:
                self.fetched, self.kept = [{} for _ in range(BLOCKS)], 0
            self.fetched[b][value] = found
            self.kept += len(found) + 1
        return found

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items whose fingerprints differ in at most radius bits."""
        pairs = []
        for b, radius in enumerate(self.radii):
            if radius < 0:
                continue
            values, at = np.unique(self.block(prints, b), return_inverse=True)
            lists = [self.fetch(b, v, _ball(radius)) for v in values.tolist()]
            sizes = np.array([len(x) for x in lists])
            begins = np.concatenate(([0], np.cumsum(sizes)))
            n = sizes[at]
            w = np.repeat(np.arange(len(prints)), n)
            i = np.concatenate(lists)[np.repeat(begins[at] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
            pairs.append(w[near].astype(np.int64) * len(self.ids) + i[near])
        met = np.unique(np.concatenate(pairs))
        return met // len(self.ids), met % len(self.ids)


_BALLS: dict[int, np.ndarray] = {}


def _ball(radius: int) -> np.ndarray:
    if radius not in _BALLS:
        _BALLS[radius] = masks(radius)
    return _BALLS[radius]


class Items:
    """One block of benchmark items, ready to be sought in documents."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int = SHINGLE, radius: int = RADIUS, similarity: float = SIMILARITY):
        self.similarity = similarity
        groups: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            n = len(text.split())
            if n:
                k = min(shingle, n)
                h = gram_hashes(text, k)
                groups[k][len(h)].append((item, h))
        self.groups = []
        for k, sizes in groups.items():
            sized = [Sized(m, found, radius) for m, found in sorted(sizes.items())]
            owners: dict[int, set[int]] = defaultdict(set)
            for at, s in enumerate(sized):
                for c in s.counts:
                    for h in c:
                        owners[h].add(at)
            hashes = np.array(sorted(owners), np.uint64)
            seen = np.zeros(BITS, bool)
            seen[hashes & np.uint64(BITS - 1)] = True
            self.groups.append((k, sized, hashes, [sorted(owners[h]) for h in hashes.tolist()], seen))

    def hits(self, text: bytes) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, distance, similarity), by first word and item."""
        out = []
        for k, sized, hashes, owners, seen in self.groups:
            h = gram_hashes(text, k) if len(text) >= 2 * k - 1 else np.empty(0, np.uint64)
            if not len(h) or (len(h) == 1 and len(text.split()) < k):
                continue
            at = np.flatnonzero(seen[h & np.uint64(BITS - 1)])
            place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            ok = hashes[place] == h[at]
            by: dict[int, list[int]] = defaultdict(list)
            for p, o in zip(at[ok].tolist(), place[ok].tolist()):
                for s in owners[o]:
                    by[s].append(p)
            for s, places in by.items():
                m = min(sized[s].size, len(h))
                best: dict[int, list[tuple[int, float, int]]] = {}
                for y, *hit in self._slide(sized[s], h, np.array(places), m):
                    spans = best.setdefault(y, [])
                    if not spans or hit[0] >= spans[-1][0] + m:
                        spans.append(tuple(hit))
                    elif hit[1] > spans[-1][1]:
                        spans[-1] = tuple(hit)
                out += [(sized[s].ids[y], p, m + k - 1, d, score) for y, spans in best.items() for p, score, d in spans]
        return sorted(out, key=lambda x: (x[1], x[0]))

    def _slide(self, sized: Sized, h: np.ndarray, places: np.ndarray, m: int) -> Iterator[tuple[int, int, float, int]]:
        """(item, window, similarity, distance) of every hit, by window: windows of m
        shingles that hold one of the places."""
        for group in np.split(places, np.flatnonzero(np.diff(places) > m) + 1):
            a, b = max(0, int(group[0]) - m + 1), min(len(h) - m, int(group[-1]))
            for at in range(a, b + 1, 4096):
                part = h[at : min(b, at + 4095) + m]
                ones = np.zeros((len(part) + 1, 64), np.int32)
                np.cumsum(np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=ones[1:])
                bits = 2 * (ones[m:] - ones[:-m]) > m
                prints = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
                w, i = sized.candidates(prints)
                for x, y in zip(w.tolist(), i.tolist()):
                    window, item = Counter(part[x : x + m].tolist()), sized.counts[y]
                    both = sum((window & item).values())
                    score = both / (m + sized.size - both)
                    if score >= self.similarity:
                        yield y, at + x, score, int(np.bitwise_count(prints[x] ^ sized.prints[y]))


def different_items(benchmark: DataFrame) -> DataFrame:
    """key and text of each different text of the benchmark, stored."""
    texts = benchmark.select(text_bytes().alias("text")).where("length(text) > 0").distinct()
    return materialize(texts.withColumn("key", F.monotonically_increasing_id()), "items")


def item_blocks(items: DataFrame, **options):
    """Blocks of items, each of at most BLOCK_ITEMS items and about BLOCK_BYTES bytes."""
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-2 * n // BLOCK_ITEMS) if n > BLOCK_ITEMS else 1, -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1)
    for b in range(blocks):
        found = items.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).orderBy("key").collect()
        yield Items([(r.key, bytes(r.text)) for r in found], **options), blocks


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity) of every hit."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    texts = different_items(benchmark)

    def one(items: Items) -> DataFrame:
        def fn(ids, texts):
            out = {x: [] for x in ("doc_id", "key", "start_word", "n_words", "distance", "similarity")}
            for doc, text in zip(ids, texts):
                for hit in items.hits(text):
                    for x, v in zip(out, (doc, *hit)):
                        out[x].append(v)
            return out

        return map_rows(rows, fn, "doc_id bigint, key bigint, start_word bigint, n_words bigint, distance int, similarity double")

    parts = [materialize(one(items), "leaks") for items, _ in item_blocks(texts, **options)]
    named = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_bytes().alias("text")).join(texts, "text").select("item_id", "key")
    return reduce(DataFrame.unionByName, parts).join(named, "key").select("doc_id", "item_id", "start_word", "n_words", "distance", "similarity")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    names = docs.columns
    at = names.index(text_col)
    for items, blocks in item_blocks(different_items(benchmark), **options):

        def fn(*columns, items=items):
            keep = [not items.hits((t or "").encode()) for t in columns[at]]
            return {n: [v for v, k in zip(c, keep) if k] for n, c in zip(names, columns)}

        docs = map_rows(docs, fn, docs.schema)
        docs = docs if blocks == 1 else materialize(docs, "clean")
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the benchmark in every document: one row for each hit."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
