"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from a bounded sample of
labelled texts. A text is encoded with every dictionary, block by block so that the
dictionary and not the text's own past explains it; the language with the fewest bytes
wins. Letters alone are compared, in lower case. A text is rejected if it has no letter
or if the runner-up needs hardly more bytes.

The sample: at most `docs_per_lang` different texts of a language, the ones lowest by a
hash of the text; copies of a text count once, so a text that many rows repeat neither
crowds out others nor loses its language. Each sampled text is read whole. A dictionary
has `dict_bytes` bytes or little more: all of its texts if they are that short, else
passages spread evenly over each whole text, the same amount of each. All else reads
every text whole, very long ones too, block by block. Null and letterless texts get "und"
and score 0 and are rejected; with no labelled text at all every text gets "und", but
those with letters are not rejected. Ties go to the language with more labelled rows,
then the lesser name. Repeated rows each give a row, an empty table an empty result.
Extra columns are kept; those named like a result are replaced.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weir.llm.common import fold, map_rows, materialize, read_table

UND = "und"
BLOCK = 1024
LEVEL = 9
PASSAGE = 160
MARGIN = 0.01
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode()


class Model:
    """Dictionaries by language, in the order that breaks ties."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK, level: int = LEVEL, margin: float = MARGIN):
        self.dictionaries, self.block, self.level, self.margin = dictionaries, block, level, margin
        self._encoders = None

    def __getstate__(self):
        return self.__dict__ | {"_encoders": None}

    def encoders(self):
        if self._encoders is None:
            self._encoders = []
            for lang, content in self.dictionaries.items():
                # Tables are sized for a block and its dictionary: 1 MB for each language, not 14.
                params = zstandard.ZstdCompressionParameters.from_level(self.level, source_size=self.block + 1, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self._encoders.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress))
        return self._encoders

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0 to 1, and whether the margin is too narrow to trust."""
        data = letters(text) if text and any(map(str.isalpha, text)) else b""
        if not data or not self.dictionaries:
            return UND, 0.0, not data
        blocks = [b" " + data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = [sum(map(len, map(encode, blocks))) for _, encode in self.encoders()]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        if len(sizes) == 1:
            return self.encoders()[0][0], 1.0, False
        margin = (sizes[order[1]] - best) / sizes[order[1]]
        weights = [math.exp((best - s) / max(1.0, 0.02 * best)) for s in sizes]
        return self.encoders()[order[0]][0], 1.0 / sum(weights), margin < self.margin


def passages(data: bytes, share: int, size: int = PASSAGE) -> bytes:
    """Passages of `size` bytes, spread evenly over all of data, about `share` bytes of them."""
    if len(data) <= share:
        return data
    n = max(1, round(share / size))
    last = len(data) - size
    return b" ".join(data[at : at + size] for at in (last * (2 * i + 1) // (2 * n) for i in range(n)))


def level(sizes: list[int], room: int) -> int:
    """The most bytes of each text with which all of them fit in the room."""
    for n, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - n) > room:
            return room // (len(sizes) - n)
        room -= size
    return max(sizes, default=0)


def fit(docs: DataFrame, docs_per_lang: int = 200, dict_bytes: int = 32768, **model) -> Model:
    """docs: text and lang of the labelled rows. One pass counts rows and different texts
    by language, one takes the sample; only the dictionaries reach the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("text").alias("h"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("different")).collect()
    if not counts:
        return Model({}, **model)
    # Four times the sample by that estimate: its error of a few hundredths leaves none short.
    share = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, 4.0 * docs_per_lang / max(1, r.different))))])
    thin = known.where(F.pmod(F.col("h"), F.lit(1 << 40)) <= share[F.col("lang")] * (1 << 40))
    different = thin.groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = different.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= docs_per_lang)
    sampled = materialize(map_rows(first.select("lang", "r", "text"), lambda lang, r, text: {"lang": lang, "r": r, "letters": list(map(letters, text))}, "lang string, r int, letters binary"), "language-sample")
    sizes: dict[str, list[int]] = {}
    for r in sampled.select("lang", F.octet_length("letters").alias("n")).collect():  # docs_per_lang numbers a language
        sizes.setdefault(r.lang, []).append(r.n)
    levels = {lang: level(n, dict_bytes) for lang, n in sizes.items()}
    cut = map_rows(sampled, lambda lang, r, data: {"lang": lang, "r": r, "part": [passages(d, levels[x]) for x, d in zip(lang, data)]}, "lang string, r int, part binary")
    parts: dict[str, list[bytes]] = {r.lang: [] for r in sorted(counts, key=lambda r: (-r.n, r.lang))}
    for r in sorted(cut.collect(), key=lambda r: (r.lang, r.r)):
        parts[r.lang].append(bytes(r.part))
    return Model({k: b" ".join(dict.fromkeys(v)) for k, v in parts.items()}, **model)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; columns of those names are replaced."""
    added = StructType.fromDDL("lang_pred string, score double, rejected boolean")
    docs = docs.drop(*[n for n in added.names if n in docs.columns])
    names = docs.columns
    at = names.index(text_col)

    def fn(*columns):
        got = [model.predict(t) for t in columns[at]]
        return dict(zip(names, columns)) | dict(zip(added.names, map(list, zip(*got))))

    return map_rows(docs, fn, StructType(docs.schema.fields + added.fields))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is not in doubt."""
    names = docs.columns
    at = names.index(text_col)

    def fn(*columns):
        keep = [not model.predict(t)[2] for t in columns[at]]
        return {n: [v for v, k in zip(c, keep) if k] for n, c in zip(names, columns)}

    return map_rows(docs, fn, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the folds that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id") % 4 == 2, F.lit(False))
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
