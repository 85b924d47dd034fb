"""Near duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints: 64 bits, a bit is 1 if it is set in over half of the XXH64 hashes of the
document's word shingles. Equal fingerprints collapse first, so groups of copies cost
one row. Each distinct fingerprint then stands in two tables, under its low and its high
segment of 32 bits. Two fingerprints at 2 bits or fewer differ in at most one bit of one
segment, so each looks up the Hamming ball of radius 1 of either segment in that
segment's table, and the complete distance of what it meets is verified. Of two segments
one bit apart, the one without the bit asks.

A segment that more than `FULL` fingerprints share would be quadratic; there the lookup
is by both segments: the ball of the other segment is enumerated too, so a bucket has
at most 33 members, and neighbours in its order are linked, which connects what all
its links connect. Nothing is left out. Components come from alternating large-star and
small-star rounds, each cut off by a stored table.

Null and empty texts have fingerprint 0 and are linked like any other. Very long texts
are read whole. Null ids take part; the smallest id that is not null names the component.
An empty table gives an empty result; extra columns are ignored, or kept by
one_of_each(); repeated rows are rows of their own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm.common import discard, drop, map_rows, materialize, read_table, text_bytes

SEED = 42
RADIUS = 2
SEGMENT = 32
FULL = 32


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, A-Z lower-cased, words joined by one space."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, n - k + 1)


MIXERS = tuple(np.uint64(xxhash.xxh64_intdigest(b"place %d" % i, SEED) | 1) for i in range(64))


def gram_hashes(text: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of each k-word shingle, A-Z lower-cased, from the words' own hashes;
    of the whole sequence if it has fewer words. Repeats are kept."""
    words = text.lower().split()
    n = len(words)
    k = min(k, n)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : n - k + 1 + i] * MIXERS[i]
    out ^= out >> np.uint64(32)
    out *= MIXERS[-1]
    return out ^ (out >> np.uint64(29))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of unsigned hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = np.ascontiguousarray(hashes[i : i + 65536], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp as a signed 64-bit integer."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return map_rows(rows, lambda ids, texts: {"doc_id": ids, "fp": [signed(majority(shingle_hashes(t, shingle))) for t in texts]}, "doc_id bigint, fp bigint")


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides grow with the input: sorted and merged by executors. A broadcast
    would have the driver build the table, and links() would have it build several at once."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def ball(segment: F.Column) -> list[F.Column]:
    """The values of a segment at one bit or none."""
    return [segment, *(segment.bitwiseXOR(F.lit(1 << bit)) for bit in range(SEGMENT))]


def links(distinct: DataFrame, full: int = FULL) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints at 2 or fewer bits that
    connect whatever the full set of such links connects."""
    low, high = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)), F.shiftrightunsigned("fp", SEGMENT)
    tagged = F.array(F.struct(low.alias("key"), high.alias("other")), F.struct((high + F.lit(1 << SEGMENT)).alias("key"), low.alias("other")))
    tables = distinct.select("fp", F.inline(tagged))
    hot = materialize(tables.groupBy("key").count().where(F.col("count") > full).select("key", F.lit(True).alias("hot")), "hot-segments")
    tables = materialize(joined(tables, hot, "key", "left").select("key", "other", "fp", F.coalesce("hot", F.lit(False)).alias("hot")), "segments")
    bits = tables.select("fp", "other", "key", F.explode(F.array(*[F.lit(1 << bit) for bit in range(SEGMENT)])).alias("bit"))
    asking = bits.where(F.col("key").bitwiseAND(F.col("bit")) == 0).select("fp", "other", F.col("key").bitwiseOR(F.col("bit")).alias("key"))
    few, many = tables.where("not hot"), tables.where("hot")
    met = [
        joined(few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b")), "key").where("a > b").select("a", "b"),
        joined(asking.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b")), "key").select("a", "b"),
    ]
    around = many.select("key", "fp", F.explode(F.array(*ball(F.col("other")))).alias("other"))
    before = around.withColumn("b", F.lag("fp").over(Window.partitionBy("key", "other").orderBy("fp")))
    met.append(before.where("b is not null").select(F.col("fp").alias("a"), "b"))
    wide = joined(asking, hot.select("key"), "key").select("key", F.col("fp").alias("a"), F.explode(F.array(*ball(F.col("other")))).alias("other"))
    met.append(joined(wide, many.select("key", "other", F.col("fp").alias("b")), ["key", "other"]).select("a", "b"))
    near = [m.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) for m in met]
    return reduce(DataFrame.unionByName, near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node it reaches.

    Large-star and small-star rounds: each ends in a stored table, and the number of rounds
    grows with the logarithm of a component's size. Minima are stored before they are
    joined, so the join reads two exchanges and Spark can split a node of many edges. What
    a round leaves behind is deleted.
    """
    spark = edges.sparkSession
    digest = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = edges.agg(*digest).first()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = joined(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = joined(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = materialize(small.distinct(), "edges")
        now = new.agg(*digest).first()
        drop(spark, edges, least, low)
        edges = new
        if now == last:
            discard(spark)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def group_by_fingerprint(prints: DataFrame) -> DataFrame:
    """prints with component_id, the smallest doc_id of its linked fingerprints."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct))
    linked = joined(distinct, roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined(linked, linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return joined(prints, named, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 3-word fingerprint and its component at 2 or fewer bits."""
    prints = materialize(fingerprints(read_table(spark, sf_dir, "documents"), shingle=3), "prints")
    out = group_by_fingerprint(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WIDE, FILTER_BITS = 4, 1 << 28
NEAR = 5
SAMPLE, COMMON, BLOCK = 16, 1 << 16, 256


def set_digest(shingles: np.ndarray) -> int:
    """The node of a set of shingles, given sorted: equal sets have equal nodes."""
    return signed(xxhash.xxh64_intdigest(np.ascontiguousarray(shingles, dtype="<u8").tobytes(), SEED))


def prefix(shingles: np.ndarray, common: np.ndarray, similarity: float) -> list[int]:
    """The first shingles of a sorted set in one order of all shingles (rare before
    common, then by hash), as many as two sets of that similarity must share one of."""
    n = len(shingles)
    if not n:
        return []
    late = np.isin(shingles, common, assume_unique=True)
    held = np.concatenate((shingles[~late], shingles[late]))[: n - int(np.ceil(similarity * n - 1e-6)) + 1]
    return held.view(np.int64).tolist()


def parities(shingles: np.ndarray, bits: int = 64 * WIDE) -> list[int]:
    """Words of 64 bits: each shingle of the set flips one bit of all."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def print_bits(n: int) -> int:
    """Bits of the long print of a set: a power of two, no fewer than its shingles."""
    return 64 * WIDE << max(0, (n - 1) // (64 * WIDE)).bit_length()


def common_shingles(rows: DataFrame, shingle: int) -> np.ndarray:
    """The COMMON most frequent shingles of a sample of the texts, sorted. They only set
    the order of shingles, which any choice keeps exact: rare ones make small buckets."""
    part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    hashed = map_rows(part, lambda ids, texts: {"h": [np.unique(gram_hashes(t, shingle)).view(np.int64).tolist() for t in texts]}, "h array<bigint>")
    counts = hashed.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def differing(p: str, q: str, wide: list[str]) -> F.Column:
    """The bits in which two parities differ: no more than the shingles that only one set has."""
    return sum((F.bit_count(F.col(f"{p}.{f}").bitwiseXOR(F.col(f"{q}.{f}"))) for f in wide), F.lit(0))


def long_differing(p: str, q: str) -> F.Column:
    """The same of long prints; one of twice the bits is folded onto the other's."""

    def xor(x: F.Column, y: F.Column) -> F.Column:
        return F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))

    def folded(x: F.Column, to: F.Column) -> F.Column:
        half = F.size(x).cast("int") / 2
        return F.when(F.size(x) > F.size(to), xor(F.slice(x, F.lit(1), half.cast("int")), F.slice(x, half.cast("int") + 1, half.cast("int")))).otherwise(x)

    a, b = F.col(p), F.col(q)
    return F.aggregate(xor(folded(a, b), folded(b, a)), F.lit(0), lambda n, x: n + F.bit_count(x))


def members(ids: DataFrame, column: str, most: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the hashed ids: a filter without false negatives. It has 16 bits for
    each id and never more than `most` (32 MB), beyond which it lets more through. One
    row of 4 KB for each 32,768 bits reaches the driver."""
    bits = min(most, 1 << max(16, (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    rows = ids.select(F.bitmap_bucket_number(at).alias("n"), F.bitmap_bit_position(at).alias("at")).groupBy("n").agg(F.bitmap_construct_agg("at").alias("map")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.map), np.uint8)[: len(out) - (r.n - 1) * 4096]
        out[(r.n - 1) * 4096 : (r.n - 1) * 4096 + len(part)] = part
    return out


def print_pairs(nodes: DataFrame, full: int = FULL) -> DataFrame:
    """(a, b), a > b: nodes whose fingerprints fp differ in at most NEAR bits, by multi-index
    hashing; stored.

    Two such prints have a segment of 32 bits in which they differ in at most two. A print
    stands in the table of either segment under every value of that segment's Hamming ball
    of radius 1, so balls around segments two bits apart meet in a bucket; the complete
    distance of what meets is verified. A bucket of more than `full` prints would be
    quadratic: there each is compared with the first and with the one before it, and so are
    the nodes of one print. What that leaves out is left to the rounds by shingles."""
    of_print = Window.partitionBy("fp").orderBy("node")
    held = nodes.select("fp", "node", F.lag("node").over(of_print).alias("before"), F.first("node").over(of_print).alias("first"))
    same = held.where("before is not null").select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("before", "first"))).alias("b"))
    low, high = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)), F.shiftrightunsigned("fp", SEGMENT)
    tables = held.where("before is null").select("fp", "node", F.explode(F.array(*ball(low), *ball(high + F.lit(1 << SEGMENT)))).alias("key"))
    order = Window.partitionBy("key").orderBy("fp")
    size = F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    one = F.struct("fp", "node")
    met = materialize(tables.select("key", one.alias("p"), size.alias("size"), F.lag(one).over(order).alias("before"), F.first(one).over(order).alias("first")).where("size > 1"), "met-prints")
    few, many = met.where(F.col("size") <= full), met.where((F.col("size") > full) & F.col("before").isNotNull())
    both = joined(few.select("key", "p"), few.select("key", F.col("p").alias("q")), "key").where("p.node > q.node").select("p", "q")
    both = both.unionByName(many.select("p", F.explode(F.array_distinct(F.array("before", "first"))).alias("q")))
    near = both.where(F.bit_count(F.col("p.fp").bitwiseXOR(F.col("q.fp"))) <= NEAR).select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b"))
    out = materialize(near.unionByName(same).distinct(), "near-prints")
    discard(nodes.sparkSession, met)
    return out


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that the components do not join."""
    for side in ("a", "b"):
        pairs = joined(pairs, roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def at_least(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes that have that share of their shingles in common.

    nodes: node and least, an id that holds it. Texts that no pair asks for are left out
    before the shuffle, and the others travel compressed."""
    asked = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    ids = nodes.join(asked, nodes.node == asked.a, "left_semi").select("least")
    bitmap = members(ids, "least")
    held = rows.sparkSession.sparkContext.broadcast(bitmap)

    def squeeze(ids, texts, at):
        at = np.array(at, np.int64)
        keep = np.flatnonzero(held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist()
        compress = zstandard.ZstdCompressor(level=3).compress
        return {"node": [set_digest(np.unique(gram_hashes(texts[i], shingle))) for i in keep], "text": [compress(texts[i]) for i in keep]}

    hashed = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(bitmap))).alias("at"))
    texts = materialize(map_rows(hashed, squeeze, "node bigint, text binary").dropDuplicates(["node"]), "asked-texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def fn(a, b, ta, tb):
        keep, last = [], {}
        text = zstandard.ZstdDecompressor().decompress

        def shingles(side, node, packed):
            if last.get(side, (None,))[0] != node:
                last[side] = node, np.unique(gram_hashes(text(packed), shingle))
            return last[side][1]

        for i in range(len(a)):
            x, y = shingles(0, a[i], ta[i]), shingles(1, b[i], tb[i])
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= similarity * (len(x) + len(y) - common):
                keep.append(i)
        return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

    out = materialize(map_rows(both.select("a", "b", "ta", "tb"), fn, "a bigint, b bigint"), "similar")
    discard(rows.sparkSession, texts)
    return out


def fits(p: str, q: str, similarity: float) -> F.Column:
    """Whether two sets whose first common shingle is at `pos` of each can be that similar."""
    common = F.least(F.col(f"{p}.n") - F.col(f"{p}.pos"), F.col(f"{q}.n") - F.col(f"{q}.pos"))
    return common >= similarity / (1 + similarity) * (F.col(f"{p}.n") + F.col(f"{q}.n")) - 1e-6


def open_members(shared: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    """The members of buckets that the edges do not yet join to one component: key, p with
    its root, lead and the number of members."""
    spark = shared.sparkSession
    roots = materialize(components(edges), "roots")
    rooted = shared.join(roots, "node", "left").select("key", "share", F.struct("node", "n", "pos", F.coalesce("root", "node").alias("root")).alias("p"))
    spread = rooted.groupBy("key").agg(F.min("p.root").alias("low"), F.max("p.root").alias("high"), F.count(F.lit(1)).alias("size"), F.max(F.struct("share", "p")).alias("lead"))
    spread = materialize(spread.where("low < high").select("key", "size", F.col("lead.p").alias("lead")), f"{tag}-buckets")
    out = materialize(rooted.join(spread, "key").select("key", "p", "lead", "size"), tag)
    discard(spark, roots, spread)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) at a similarity of word shingles, of each row with an id.

    Texts of equal sets of shingles are one node with one SimHash fingerprint. The first
    round finds links by the method: prints at NEAR bits or fewer meet in segment tables,
    and their shingles are compared. Prints at that similarity can be farther apart (up to
    15 bits), which no ball within a segment reaches, so three rounds by shingles complete
    the links. A node stands in the bucket of each shingle of its prefix, so nodes at that
    similarity share a bucket. Of these rounds, the first compares a member with the
    bucket's first and with the one before it, the second with the member that shares most
    of its prefix, which is the original of a star of copies. The third compares every pair
    of a bucket. All three leave out what earlier links join already, the third works in
    blocks; so dense groups cost few pairs, and no pair that could add a link goes unseen.
    Other pairs are left out only by bounds that hold: by places in the prefix, by parities
    in 256 bits, then by parities in as many bits as there are shingles. The others have
    their shingles compared. Texts without words are copies of each other.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text")).where("doc_id is not null")
    common = spark.sparkContext.broadcast(common_shingles(rows, shingle))
    wide = [f"f{i}" for i in range(WIDE)]

    def fn(ids, texts):
        sets = [np.unique(gram_hashes(t, shingle)) for t in texts]
        prints = [parities(h) for h in sets]
        out = {"doc_id": ids, "node": [set_digest(h) for h in sets], "fp": [signed(majority(h)) for h in sets], "n": [len(h) for h in sets], "keys": [prefix(h, common.value, similarity) for h in sets]}
        out["long"] = [parities(h, print_bits(len(h))) for h in sets]
        return out | {f: [w[i] for w in prints] for i, f in enumerate(wide)}

    made = materialize(map_rows(rows, fn, "doc_id bigint, node bigint, fp bigint, n int, keys array<bigint>, long array<bigint>, " + ", ".join(f"{f} bigint" for f in wide)), "wide-prints")
    prints = materialize(made.select("doc_id", "node"), "holders")
    nodes = materialize(made.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "n", "keys", "long", *wide)]), "wide-nodes")
    discard(spark, made)

    def links_of(pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs (a, b) that are similar enough, as edges."""
        for side in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("node").alias(side), F.struct("n", *wide).alias(f"p{side}")), side)
        alone = (1 - similarity) / (1 + similarity) * (F.col("pa.n") + F.col("pb.n")) + 1e-6
        few = materialize(pairs.where(differing("pa", "pb", wide) <= alone).select("a", "b", alone.alias("alone")), f"{tag}-few")
        near = few
        for side in ("a", "b"):
            near = near.join(nodes.select(F.col("node").alias(side), F.col("long").alias(f"p{side}")), side)
        near = materialize(near.where(long_differing("pa", "pb") <= F.col("alone")).select("a", "b"), f"{tag}-pairs")
        out = at_least(near, rows, nodes, shingle, similarity)
        discard(spark, few, near)
        return out

    def placed(pairs: DataFrame) -> DataFrame:
        """The pairs (p, q) whose places in the prefix allow that similarity, as (a, b)."""
        return pairs.where(fits("p", "q", similarity)).select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b")).distinct()

    near = print_pairs(nodes)
    edges = links_of(near, "print")
    discard(spark, near)
    roots = materialize(components(edges), "print-roots")
    tables = nodes.select("node", "n", F.posexplode("keys").alias("pos", "key")).select("key", "node", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("pos").cast("bigint")).alias("at"))
    order = Window.partitionBy("key").orderBy("node")
    met = tables.select("key", "node", "at", *[f(c).over(order).alias(f"{tag}_{c}") for tag, f in (("before", F.lag), ("first", F.first)) for c in ("node", "at")], F.lead("node").over(order).alias("after"))
    met = materialize(met.where("before_node is not null or after is not null").drop("after"), "met")

    def member(node: str, at: str) -> F.Column:
        return F.struct(F.col(node).alias("node"), F.shiftright(at, 32).cast("int").alias("n"), F.col(at).bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))

    neighbours = F.explode(F.array_distinct(F.array(member("before_node", "before_at"), member("first_node", "first_at"))))
    pairs = placed(met.where("before_node is not null").select(member("node", "at").alias("p"), neighbours.alias("q")))
    edges = edges.unionByName(links_of(apart(pairs, roots), "neighbour"))
    # A set of n shingles has a prefix of n - ceil(similarity * n) + 1: the share of it that others hold.
    kept = F.shiftright(F.first("at"), 32)
    shares = materialize(met.groupBy("node").agg((F.count(F.lit(1)) / (kept - F.ceil(similarity * kept - 1e-6) + 1)).alias("share")), "shares")
    shared = materialize(met.join(shares, "node").select("key", "node", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), "share"), "shared")
    discard(spark, met, shares, roots)
    left = open_members(shared, edges, "led")
    edges = edges.unionByName(links_of(placed(left.where("p.root <> lead.root").select("p", F.col("lead").alias("q"))), "leader"))
    discard(spark, left)
    left = open_members(shared, edges, "rest")
    discard(spark, shared)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    one = left.select("key", F.pmod(F.xxhash64("p.node"), blocks).cast("int").alias("block"), "p")
    other = left.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("p").alias("q"))
    edges = edges.unionByName(links_of(placed(one.join(other, ["key", "block"]).where("p.node > q.node and p.root <> q.root")), "rest"))
    discard(spark, left)
    roots = components(edges)
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = materialize(named.join(least, "root").select("node", "component_id"), "components")
    discard(spark, nodes, named)
    return prints.join(of_node, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, but for near duplicates of a smaller id. Rows with a
    null id all stay; of repeated rows of one id, each stays."""
    groups = near_duplicates(docs, shingle, similarity, id_col)
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone["_gone"], "left_anti")
