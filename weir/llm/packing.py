"""Best-fit packing of token sequences with large-item matching.

Documents are tokenized whole and only those longer than the capacity are cut. The plan
is made on the histogram of piece lengths, which has at most `capacity` entries however
many documents there are: lengths above one third of the capacity are matched greedily,
at most two to a bin, the longest with the longest that still fits; the shorter ones go
by best fit into the gaps that are left, longest first, and open new bins only when no
gap takes them. Whole runs of equal bins are handled at once, so the plan is a list of
runs: pieces of one length with ranks r0 to r1 lie at one offset of sequences s0 onwards.
Pieces find their run by their rank among the pieces of their length. Ranks are counted
within (length, salt) cells, so a length that a third of all rows share is spread.

Null and empty texts are the one end id. Null doc_ids are kept. An empty table gives an
empty result. Repeated rows are each packed. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm.common import map_rows, materialize, read_table, text_bytes

CAPACITY = 4096
END_ID = 1
SALTS = 32
MEMO = 100_000
BATCH_ROWS = 4000
#: Lower-case letters that no normalization changes, and ASCII punctuation without the
#: apostrophe: the pre-tokenizer cuts between the two.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
MARKS = "".join(c for c in string.punctuation if c != "'")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others in order from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}


class Encoder:
    """Token ids of many texts at once.

    The pre-tokenizer of the vocabulary never joins characters across ASCII white space,
    so texts are split there, and each distinct run of other characters is looked up once
    a batch. A run of plain letters with plain punctuation behind it needs no normalization
    but for case: its halves go to the tokenizer's model at once and are remembered, in two
    generations of at most `memo` entries, so "Word", "word" and "word," are one entry. Any
    other run goes through all of the tokenizer and is remembered by itself.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def _half(self, half: str) -> bytes | None:
        """Ids of lower-case plain letters or of plain punctuation, None for anything else."""
        found = self.young.get(half)
        if found is None:
            found = self.old.get(half)
            if found is None:
                if half[-1] not in MARKS and LETTERS.fullmatch(half) is None:
                    return None
                seen = half if half.isascii() else half.encode().decode("latin-1").translate(self.letters)
                found = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
            self.young[half] = found
        return found

    def _run(self, run: str) -> bytes:
        letters = run.rstrip(MARKS)
        found = self._half(letters.lower()) if letters else b""
        if found is None:
            found = self.other.get(run)
            if found is None:
                self.other[run] = found = array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
            return found
        return found + self._half(run[len(letters) :]) if len(letters) < len(run) else found

    def words(self, vocabulary: list[str]) -> list[bytes]:
        """Ids of each run of characters."""
        if len(self.young) > self.memo:
            self.young, self.old = {}, self.young
        if len(self.other) > self.memo:
            self.other = {}
        young, run, out = self.young, self._run, []
        for w in vocabulary:
            found = young.get(w)
            out.append(run(w) if found is None else found)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin and end."""
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        parts = self.words(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = np.frombuffer(b"".join(parts), "<u4")
        begins = np.concatenate(([0], np.cumsum(sizes)))
        codes = flat.indices.to_numpy()
        n = sizes[codes]
        upto = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(begins[codes] - upto[:-1], n) + np.arange(upto[-1])
        return ids[at], upto[bounds]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32[, ids as bytes]."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def fn(ids, texts):
        all_ids, bounds = encoder(tokenizer).encode(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist()):
            data = all_ids[a:b].tobytes() + end
            for n, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                for k, v in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                    out[k].append(v)
        return out

    return map_rows(rows, fn, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""), batch_rows=BATCH_ROWS)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, first sequence, offset), each up to the next of its
    length: the pieces of a length, in rank order, lie at that offset of successive
    sequences."""
    runs: list[tuple[int, int, int, int]] = []
    rank = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, how many)]
    order: list[int] = []
    bins = 0

    def put(length: int, first: int, times: int, offset: int) -> None:
        runs.append((length, rank[length], first, offset))
        rank[length] += times

    def leave(gap: int, first: int, times: int) -> None:
        if gap and times:
            if gap not in gaps:
                insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, times))

    left = {n: c for n, c in counts.items() if c}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    while large:
        n = large[0]
        mate = next((m for m in large if m <= capacity - n and (m != n or left[n] > 1)), None)
        times = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
        put(n, bins, times, 0)
        if mate is None:
            leave(capacity - n, bins, times)
        else:
            put(mate, bins, times, n)
            leave(capacity - n - mate, bins, times)
            left[mate] -= times
        left[n] -= times
        bins += times
        large = [m for m in large if left[m]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(order, n)
            if at == len(order):
                k = capacity // n
                fresh = max(1, todo // k)
                leave(capacity, bins, fresh)
                bins += fresh
                continue
            gap = order[at]
            first, times = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            k = min(gap // n, todo)
            full = min(times, todo // k)
            for i in range(k):
                put(n, first, full, capacity - gap + i * n)
            todo -= full * k
            leave(gap - k * n, first, full)
            leave(gap, first + full, times - full)
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """parts (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = parts.sparkSession
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "_salt").collect()  # at most capacity * salts rows
    counts: dict[int, int] = {}
    base: dict[int, int] = {}
    for r in cells:
        base[r.length * salts + r["_salt"]] = counts.get(r.length, 0)
        counts[r.length] = counts.get(r.length, 0) + r.n
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 4)
    span = 1 << 44
    keys, cell_keys = runs[:, 0] * span + runs[:, 1], np.array(sorted(base), np.int64)
    cell_base = np.array([base[k] for k in cell_keys.tolist()], np.int64)
    held = spark.sparkContext.broadcast((keys, runs, cell_keys, cell_base))  # bounded by capacity * salts, whatever the input
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(within).cast("bigint") - 1)
    names = parts.columns
    n_at = names.index("length")

    def fn(*columns):
        keys, runs, cell_keys, cell_base = held.value
        length, salt, rank = np.array(columns[n_at], np.int64), np.array(columns[-2], np.int64), np.array(columns[-1], np.int64)
        rank = rank + cell_base[np.searchsorted(cell_keys, length * salts + salt)]
        at = np.searchsorted(keys, length * span + rank, side="right") - 1
        return dict(zip(names, columns)) | {"sequence_id": (runs[at, 2] + rank - runs[at, 1]).tolist(), "offset": runs[at, 3].tolist()}

    from pyspark.sql.types import StructType

    return map_rows(ranked, fn, StructType(parts.schema.fields + StructType.fromDDL("sequence_id bigint, offset bigint").fields))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document in sequences of at most `capacity` ids, the end id included."""
    return pack(materialize(pieces(docs, tokenizer or public_tokenizer(), capacity), "pieces", BATCH_ROWS), capacity)
