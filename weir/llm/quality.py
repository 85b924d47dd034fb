"""Quality scores from random-indexing word vectors and a two-layer network.

Each word of a bounded vocabulary owns a sparse ternary index vector drawn from its
hash; a word's vector is the sum of the index vectors of its neighbours in the training
texts, damped and scaled to unit length. Words outside the vocabulary share the vector
of their shape; a word said again within three places counts as a pseudo-word too. A
document pools the mean and the spread of the vectors of all its words; a network with
one hidden layer, trained with numpy, maps the pool to a logit, and a temperature fitted
on rows that the network did not see turns it into a probability.

Fitting reads a bounded sample of the labelled rows, at most `MAX_ROWS`, lowest by a hash
of their id. Their texts are read whole, as in scoring: words are counted, neighbours
summed and texts pooled by executors, and only the vocabulary, its vectors and one pool
a sampled row reach the driver, whatever the length of the texts.

Null, empty and wordless texts pool to zeros and are scored like any other. Very long
texts are read in stretches. Without labels of both classes every score is the share of
label 1, or 0.5 without labels. Repeated labels of an id count once, by the smallest, and
of repeated rows of a labelled id the least text is learned from; each row is scored. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weir.llm.common import arrow_schema, fold, map_rows, materialize, parts_of, read_table

MAX_ROWS, VOCABULARY, DIMS, NEIGHBOURS, HIDDEN = 3000, 20_000, 64, 2, 32
STRETCH, TOKENS = 1 << 20, 200_000
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SPACE = re.compile(r"\s")
SEED = 7
AGAIN = ("\0again1", "\0again2", "\0again3")  # stand for a word equal to the one so many places before
SHAPES = ("\0.0", *(f"\0{kind}{n}" for kind in ("#", "A", "Aa", "a") for n in range(1, 13)), *AGAIN)


def shape(word: str) -> str:
    if not word[0].isalnum():
        return "\0.0"
    kind = "#" if word[0].isdigit() else "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"
    return f"\0{kind}{min(len(word), 12)}"


def stretches(text: str, size: int = STRETCH) -> Iterator[list[str]]:
    """The words of a text, some at a time; a stretch ends at white space."""
    at = 0
    while at < len(text):
        stop = SPACE.search(text, at + size)
        end = stop.start() if stop else len(text)
        yield WORD.findall(text, at, end)
        at = end


def index_vector(word: str, dims: int = DIMS) -> list[tuple[int, float]]:
    """Four places of +1 or -1, drawn from the word's hash."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED)
    return [(((h >> (16 * i) & 0xFFFF) >> 1) % dims, 1.0 if h >> (16 * i) & 1 else -1.0) for i in range(4)]


class Vocabulary:
    """Places of the known words and of all shapes, and their index vectors."""

    def __init__(self, known: list[str], dims: int = DIMS):
        self.at = {w: i for i, w in enumerate([*known, *SHAPES])}
        self.dims = dims
        sparse = [index_vector(w, dims) for w in self.at]
        self.places = np.array([[p for p, _ in v] for v in sparse], np.int64)
        self.signs = np.array([[s for _, s in v] for v in sparse])

    def index(self) -> np.ndarray:
        out = np.zeros((len(self.at), self.dims))
        for i in range(4):
            np.add.at(out, (np.arange(len(out)), self.places[:, i]), self.signs[:, i])
        return out

    def add(self, words: list[str | None], table: np.ndarray, skip: int = 0, reach: int = NEIGHBOURS) -> None:
        """Add to table, flat, the index vectors of the neighbours of each word; None is
        nobody's neighbour, and pairs among the first `skip` words were added before."""
        forms = np.array([-1 if w is None else self.at[shape(w)] for w in words], np.int64)
        ids = np.array([self.at.get(w, -1) for w in words], np.int64)
        ids = np.where(ids < 0, forms, ids)
        for rows in (ids, forms):
            for d in range(1, reach + 1):
                first = max(d, skip)
                late, early = rows[first:], rows[first - d : len(rows) - d]
                ok = (late >= 0) & (early >= 0)
                for a, b in ((late[ok], early[ok]), (early[ok], late[ok])):
                    for i in range(4):
                        table += np.bincount(a * self.dims + self.places[b, i], self.signs[b, i], len(table))

    def vectors(self, table: np.ndarray) -> Vectors:
        index = self.index()
        table = table + index
        norm = np.linalg.norm(table, axis=1, keepdims=True)
        return Vectors(self.at, np.vstack([table / np.maximum(norm, 1e-6) + 0.5 * index, np.zeros((1, self.dims))]).astype(np.float32))


class Vectors:
    """Random-indexing vectors of the vocabulary."""

    def __init__(self, at: dict[str, int], table: np.ndarray):
        self.at, self.table = at, table

    def pool(self, text: str | None) -> np.ndarray:
        """Mean and spread of the word vectors of a whole text."""
        words: Counter = Counter()
        before: list[str] = []
        for part in stretches(text or ""):
            words.update(part)
            joined = before + part
            for d, a in enumerate(AGAIN, 1):
                skip = max(0, len(before) - d)  # pairs that begin there were counted with the stretch before
                words[a] += sum(map(eq, joined[skip:], joined[skip + d :]))
            before = joined[-len(AGAIN) :]
        counts: Counter = Counter()
        get = self.at.get
        for word, times in words.items():
            if times:
                i = get(word)
                counts[i if i is not None else get(shape(word), -1)] += times
        n = sum(counts.values())
        if not n:
            return np.zeros(2 * self.table.shape[1], np.float32)
        rows = self.table[list(counts)]
        share = (np.fromiter(counts.values(), np.float64, len(counts)) / n).astype(np.float32)
        mean = share @ rows
        return np.concatenate((mean, np.sqrt(np.maximum(share @ (rows * rows) - mean * mean, 0))))


class Network:
    """Standardised input, one ReLU layer, a logit and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 150, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.std, self.temperature = x.mean(0), x.std(0) + 1e-3, 1.0
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5)
        fit, rest = order[cut:], order[:cut]
        z = (x - self.mean) / self.std
        shapes = ((x.shape[1], hidden), (hidden,), (hidden, 1), (1,))
        self.w = [rng.normal(0, (2 / s[0]) ** 0.5, s) if len(s) == 2 else np.zeros(s) for s in shapes]
        m, v, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
                if not len(part):
                    continue
                a = np.maximum(z[part] @ self.w[0] + self.w[1], 0)
                p = 1 / (1 + np.exp(-np.clip(a @ self.w[2] + self.w[3], -30, 30)))
                d = (p - y[part, None]) / len(part)
                back = (d @ self.w[2].T) * (a > 0)
                grads = (z[part].T @ back + 1e-4 * self.w[0], back.sum(0), a.T @ d + 1e-4 * self.w[2], d.sum(0))
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.temperature = min((float(k) for k in np.geomspace(0.25, 8, 60)), key=lambda k: self._loss(x[rest], y[rest], k))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.maximum((x - self.mean) / self.std @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])[:, 0]

    def _loss(self, x: np.ndarray, y: np.ndarray, k: float) -> float:
        s = self.logits(x) / k
        return float(np.mean(np.logaddexp(0, s) - y * s))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


class Model:
    """The share of label 1 and, where both labels were seen, vectors and network."""

    def __init__(self, share: float, vectors: Vectors | None = None, network: Network | None = None):
        self.share, self.vectors, self.network = share, vectors, network

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.network is None or not texts:
            return [self.share] * len(texts)
        return self.network.predict(np.stack([self.vectors.pool(t) for t in texts])).tolist()


def sample(docs: DataFrame, labels: DataFrame, rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, quality) of the labelled rows lowest by a hash of their id, stored."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(few), "doc_id")  # at most `rows` rows of two numbers
    return materialize(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")), "quality-sample")


def known_words(found: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The most frequent words of the sample, of those said three times or more."""

    def fn(texts):
        counts = [Counter(w for part in stretches(t) for w in part) for t in texts]
        return {"word": [list(c) for c in counts], "n": [list(c.values()) for c in counts]}

    each = map_rows(found.select("text"), fn, "word array<string>, n array<bigint>").select(F.inline(F.arrays_zip("word", "n")))
    counted = each.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 3")
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


def neighbours(found: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The summed index vectors of each word's neighbours; a task adds up its own texts."""
    dims, n = vocabulary.dims, len(vocabulary.at)
    schema = StructType.fromDDL("word int, " + ", ".join(f"v{i} double" for i in range(dims)))
    arrow = arrow_schema(schema)
    held = found.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by its size

    def run(batches):
        table, words, skip = np.zeros(n * dims), [], 0
        for batch in batches:
            for part in parts_of(batch, 1000, 8 << 20):
                for text in part.column(0).to_pylist():
                    words += [None] * NEIGHBOURS
                    for more in stretches(text):
                        words += more
                        if len(words) > TOKENS:
                            held.value.add(words, table, skip)
                            words, skip = words[-NEIGHBOURS:], NEIGHBOURS
        held.value.add(words, table, skip)
        rows = table.reshape(n, dims)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(rows[some, i]) for i in range(dims))], schema=arrow)

    sums = found.select("text").mapInArrow(run, schema).groupBy("word").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(dims)])
    got = sums.toArrow()  # a row for each word of the vocabulary
    out = np.zeros((n, dims))
    if got.num_rows:
        out[got["word"].to_numpy()] = np.stack([got[f"v{i}"].to_numpy() for i in range(dims)], axis=1)
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_ROWS) -> Model:
    found = sample(docs, labels, rows)
    share = found.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("ones")).first()
    if share.ones in (0, share.n):
        return Model(share.ones / share.n if share.n else 0.5)
    vocabulary = Vocabulary(known_words(found))
    vectors = vocabulary.vectors(neighbours(found, vocabulary))
    held = found.sparkSession.sparkContext.broadcast(vectors)
    pooled = map_rows(found, lambda ids, texts, labels: {"doc_id": ids, "x": [held.value.pool(t).tobytes() for t in texts], "y": [int(q == 1) for q in labels]}, "doc_id bigint, x binary, y int")
    got = sorted(pooled.collect(), key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))  # one pool for each of `rows` rows
    x = np.stack([np.frombuffer(bytes(r.x), np.float32) for r in got])
    return Model(share.ones / share.n, vectors, Network(x, np.array([r.y for r in got], np.float64)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def fn(ids, texts):
        s = held.value.scores(texts)
        return {"doc_id": ids, "score": s, "predicted": [int(x >= 0.5) for x in s]}

    return map_rows(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), fn, "doc_id bigint, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; a third of the labels is held out of the fit."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id") % 3 != 1))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
