"""Exact top-k by inner product with Fagin's threshold algorithm.

Different vectors are dealt into blocks by a hash. Each block is packed once: its
components, and for each dimension the list of its rows in order. Queries are dealt into
blocks of their own, and a task holds one block of either. For each query it reads the
lists from the end that the query's component favours, first those whose next values fall
the most when weighed by the component; scores what it meets for the first time in full;
and stops when no unmet vector can beat, nor tie with, the kth score. The bound of the
unmet holds the last values read and the largest norm of the block together, so it is
never above the plain sum of the last values. Every query first searches one block, which
gives it a kth score, and that score cuts the search in all others short.

Where the lists say little (many dimensions, all alike, as in random vectors) no bound
falls before most rows are met; the search is then a scan, still exact.

Vectors that are null, empty, or hold null or non-finite components take no part.
Missing trailing components count as zero. Candidates with the query's own id are its
own row. Repeated rows are candidates of their own, and repeated query rows are queries
of their own: each has its k rows, under the one query_id. Equal rows of one id are
searched once and counted, so no key makes a block large. Scores are exact: in double
while no sum can reach 2**53, else in Python integers, held within the range of a long.
An empty table, or one without queries, gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm.common import materialize, read_table, ship

SCALE, K = 1024, 10
BLOCK, QUERIES, VALUES = 8192, 2048, 1 << 22  # rows of a block, queries of a block, components of either
STEP = 32


def whole(rows: np.ndarray) -> np.ndarray:
    """floor(1024 x) of each component, as whole numbers in float64."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * rows)


def whole_exactly(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 2**53 else floor(SCALE * x)


def unmet_bound(weight: np.ndarray, limit: np.ndarray, norm2: float) -> float:
    """No less than the largest sum of weight * s with s <= limit and a squared norm of at
    most norm2; weight >= 0. By duality each multiplier gives such a bound."""
    best = float(weight @ limit)
    size = float(np.sqrt(weight @ weight))
    if 0 < norm2 < np.inf and size > 0:
        for m in size / np.sqrt(norm2) * np.array([0.5, 0.55, 0.62, 0.7, 0.8, 1.0, 1.3, 2.0]):
            s = np.minimum(weight / (2 * m), limit)
            best = min(best, float(weight @ s - m * (s @ s) + m * norm2))
    return best + 1e-9 * abs(best) + 1e-6


def threshold_topk(x: np.ndarray, ids: np.ndarray, order: np.ndarray, q: np.ndarray, own: int, k: int = K, copies: np.ndarray | None = None, floor_score: float = -np.inf, norm2: float | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """((score, id, copies) of the k best, by score and then smaller id; how many rows were
    scored). order: the rows by each dimension, ascending. Candidates below floor_score
    may be left out."""
    n, copies = len(x), np.ones(len(x), np.int64) if copies is None else copies
    dims = np.flatnonzero(q)
    weight, sign = np.abs(q[dims]), np.sign(q[dims])
    norm2 = (float((x * x).sum(axis=1).max(initial=0)) if norm2 is None else norm2) * (1 + 1e-9)
    depth = np.zeros(len(dims), np.int64)
    fresh = ids != own
    scores, found, scored, step = np.empty(0), np.empty(0, np.int64), 0, STEP

    def row(d: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row at a place of each list, read from its favoured end."""
        return order[np.where(sign[d] > 0, n - 1 - at, at), dims[d]]

    every = np.arange(len(dims))
    last = sign * x[row(every, depth), dims] if len(dims) else np.empty(0)
    while True:
        if 3 * scored > n or not len(dims) or depth.min() >= n:
            met = np.flatnonzero(fresh)  # most are met: one product settles the rest
        else:
            to = np.minimum(depth + step, n)
            ahead = sign * x[row(every, to - 1), dims]
            fall = weight * (last - ahead)
            read = np.flatnonzero((fall >= fall.mean()) & (depth < n))
            read = read if len(read) else np.flatnonzero(depth < n)
            rows = np.concatenate([order[n - to[d] : n - depth[d], dims[d]] if sign[d] > 0 else order[depth[d] : to[d], dims[d]] for d in read.tolist()])
            depth[read], last[read] = to[read], ahead[read]
            met = np.unique(rows)
            met = met[fresh[met]]
        fresh[met] = False
        scored += len(met)
        got = x[met] @ q if 2 * len(met) < n else (x @ q)[met]
        may = got >= (max(scores[-1], floor_score) if copies[found].sum() >= k else floor_score)
        scores, found = np.concatenate((scores, got[may])), np.concatenate((found, met[may]))
        best = np.lexsort((ids[found], -scores))
        best = best[: np.searchsorted(np.cumsum(copies[found[best]]), k) + 1]
        scores, found = scores[best], found[best]
        kth = max(scores[-1], floor_score) if copies[found].sum() >= k else floor_score
        if not fresh.any() or kth > unmet_bound(weight, last, norm2):
            return [(int(s), int(ids[i]), int(copies[i])) for s, i in zip(scores, found)], scored
        step *= 2


def exact_topk(rows: list[list[int]], ids: np.ndarray, q: list[int], own: int, k: int = K, copies: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The same in Python integers, for components too large for doubles."""
    top = (1 << 63) - 1
    copies = np.ones(len(rows), np.int64) if copies is None else copies
    scored = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(row, q)))), int(i), int(c)) for row, i, c in zip(rows, ids, copies) if i != own)
    out, n = [], 0
    for s, i, c in scored:
        if n >= k:
            break
        out.append((-s, i, c))
        n += c
    return out


class Block:
    """Packed rows of vectors: raw components, ids, copies and sorted lists."""

    FIELDS = "width int, ids binary, copies binary, raw binary, lists binary"

    def __init__(self, width: int, ids: bytes, copies: bytes, raw: bytes, lists: bytes):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.raw = np.frombuffer(raw).reshape(-1, width)
        self.x = whole(self.raw)
        self.lists = np.frombuffer(lists, np.int32).reshape(-1, width)
        self.most = float(np.abs(self.x).max(initial=0))
        self.norm2 = float((self.x * self.x).sum(axis=1).max(initial=0)) if self.most < 2**26 else np.inf

    @staticmethod
    def pack(ids: list[int], copies: list[int], vectors: list, with_lists: bool = True) -> tuple:
        raw = np.zeros((len(vectors), max(map(len, vectors))))
        for i, v in enumerate(vectors):
            raw[i, : len(v)] = v
        lists = np.argsort(whole(raw), axis=0, kind="stable").astype(np.int32) if with_lists else np.empty((0, raw.shape[1]), np.int32)
        return raw.shape[1], np.array(ids, np.int64).tobytes(), np.array(copies, np.int64).tobytes(), raw.tobytes(), lists.tobytes()

    def search(self, raw: np.ndarray, own: int, k: int, floor_score: int | None) -> list[tuple[int, int, int]]:
        width = self.x.shape[1]
        raw = np.pad(raw[:width], (0, max(0, width - len(raw))))
        q = whole(raw)
        if width * self.most * np.abs(q).max(initial=0) < 2**53:
            return threshold_topk(self.x, self.ids, self.lists, q, own, k, self.copies, -np.inf if floor_score is None else floor_score, self.norm2)[0]
        rows = [[whole_exactly(v) for v in r] for r in self.raw.tolist()]
        return exact_topk(rows, self.ids, [whole_exactly(v) for v in raw.tolist()], own, k, self.copies)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors: vec_id, embedding; queries: the same."""
    ship(vectors.sparkSession)
    sound = "vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"

    def different(df: DataFrame, tag: str) -> tuple[DataFrame, int, int]:
        rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(sound)
        stored = materialize(rows.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies")).withColumn("place", F.monotonically_increasing_id()), tag)
        n, width = stored.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        return stored, n, width or 1

    rows, n, width = different(vectors, "vectors")
    asked, n_asked, _ = different(queries, "queries")
    blocks = -(-n // max(1, min(block, VALUES // width))) or 1
    parts = -(-n_asked // max(1, min(query_block, VALUES // width))) or 1
    by_hash = F.pmod(F.xxhash64("vec_id", "place"), F.lit(blocks)).cast("int")

    def packed(df: DataFrame, key: F.Column, tag: str, with_lists: bool) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            row = Block.pack(pdf["vec_id"].tolist(), pdf["copies"].tolist(), pdf["embedding"].tolist(), with_lists)
            return pd.DataFrame([(pdf["key"].iloc[0], pdf["place"].to_numpy(np.int64).tobytes(), *row)], columns=["key", "places", *(f.split()[0] for f in Block.FIELDS.split(", "))])

        return materialize(df.withColumn("key", key).groupBy("key").applyInPandas(one, f"key int, places binary, {Block.FIELDS}"), tag)

    held = packed(rows, by_hash, "blocks", True)
    probes = packed(asked, F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int"), "probes", False)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One block of queries in one block of vectors; floors come beside the queries."""
        out = []
        if len(left) and len(right):
            fields = [f.split()[0] for f in Block.FIELDS.split(", ")]
            r, p = right.iloc[0], left.iloc[0]
            target, probe = Block(*[r[f] for f in fields]), Block(*[p[f] for f in fields])
            floors = dict(zip(np.frombuffer(p["with_floor"], np.int64).tolist(), np.frombuffer(p["floors"], np.int64).tolist())) if p["floors"] is not None else {}
            for place, own, raw in zip(np.frombuffer(p["places"], np.int64).tolist(), probe.ids.tolist(), probe.raw):
                out += [(place, other, score, c) for score, other, c in target.search(raw, own, k, floors.get(place))]
        return pd.DataFrame(out, columns=["place", "vec_id", "score", "copies"]).astype("int64")

    def cells(pairs: DataFrame, floors: DataFrame | None) -> DataFrame:
        """pairs: (a, b) of a block of queries and a block of vectors."""
        ask = probes
        if floors is not None:
            ask = ask.join(floors, ask.key == floors.a, "left").drop("a")
        else:
            ask = ask.select("*", F.lit(None).cast("binary").alias("with_floor"), F.lit(None).cast("binary").alias("floors"))
        left = pairs.join(ask.withColumnRenamed("key", "a"), "a")
        right = pairs.select(F.col("a").alias("to"), F.col("b").alias("key")).join(held, "key")
        return left.groupBy("a", "b").cogroup(right.groupBy("to", "key")).applyInPandas(search, "place bigint, vec_id bigint, score bigint, copies bigint")

    home = F.pmod(F.col("a"), F.lit(blocks)).cast("int")
    grid = probes.select(F.col("key").alias("a"))
    found = materialize(cells(grid.withColumn("b", home), None), "home")
    if blocks > 1:
        order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id").rowsBetween(Window.unboundedPreceding, 0)
        kth = found.withColumn("upto", F.sum("copies").over(order)).where(F.col("upto") >= k).groupBy("place").agg(F.max("score").alias("score"))

        def pack_floors(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(pdf["a"].iloc[0], pdf["place"].to_numpy(np.int64).tobytes(), pdf["score"].to_numpy(np.int64).tobytes())], columns=["a", "with_floor", "floors"])

        keyed = kth.withColumn("a", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int"))
        floors = keyed.groupBy("a").applyInPandas(pack_floors, "a int, with_floor binary, floors binary")
        others = grid.select("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).where(F.col("b") != home)
        found = found.unionByName(cells(others, materialize(floors, "floors")))
    # Runs of equal candidates are cut at k, then dealt out as rows of their own.
    every = found.select("place", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))).alias("_")).drop("_")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
    best = every.withColumn("rank", rank).where(F.col("rank") <= k)
    named = asked.select("place", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_")).drop("_")
    return best.join(named, "place").select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all rows for each row whose vec_id is divisible by 100."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum([q.e[i] * v.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
