"""Language identification by compression with per-language dictionaries.

Every language has a zstandard dictionary of raw text. A text's letters are encoded with each,
and the language with the smallest encoding wins. Encoding goes in frames of fixed length, each
started anew from the dictionary, so that a long text does not become its own dictionary.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialloom.llm.labelled import held_out, remainder
from trialloom.llm.texts import pieces

#: Documents per language that dictionaries are drawn from (those with the smallest hash), the
#: length of the windows that their texts are cut into, and the bytes of a dictionary.
FIT_DOCS, WINDOW, DICTIONARY = 512, 512, 1 << 16
LEVEL, FRAME = 6, 1024
#: Texts are rejected if the second language's encoding is not longer by this share.
MARGIN = 0.005
UNKNOWN = "und"
OTHER = regex.compile(r"\P{L}+")


def letters(text: str) -> bytes:
    """Lower-cased words of letters with one blank between them, in UTF-8."""
    return OTHER.sub(" ", text.lower()).strip().encode()


@dataclass
class Model:
    """Dictionaries, the most frequent language first; that order settles ties."""

    dictionaries: list[tuple[str, bytes]]
    coders: list = field(default_factory=list)

    def _coders(self) -> list:
        if not self.coders:
            for _, text in self.dictionaries:
                held = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=LEVEL)
                coder = zstandard.ZstdCompressor(
                    dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
                )
                self.coders.append(coder.compress)
        return self.coders

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is accepted."""
        sizes = [0] * len(self.dictionaries)
        coders, some = self._coders(), False
        for piece in pieces(text or ""):
            data = letters(piece)
            some = some or bool(data)
            for at in range(0, len(data), FRAME):
                frame = data[at : at + FRAME]
                sizes = [n + len(code(frame)) for n, code in zip(sizes, coders)]
        if not some or not sizes:
            return UNKNOWN, 0.0, False
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]]
        margin = (second - best) / second
        return self.dictionaries[order[0]][0], 1 / (1 + (best / second) ** 16), margin >= MARGIN


_loaded: dict[str, Model] = {}


def fit(docs: DataFrame, divisor: int = 4, value: int = 2) -> Model:
    """Dictionaries from a bounded sample of documents that aren't held out.

    For each language the ``FIT_DOCS`` documents with the smallest hash are cut into windows, and
    those with the smallest hash fill the dictionary, so all parts of a text may be drawn.
    """
    # documents with no language, id or text teach nothing
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), "text")
    known = known.where((remainder(F.col("doc_id"), divisor) != value) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted(known.groupBy("lang").count().collect(), key=lambda r: (-r[1], r[0]))
    if not counts:
        return Model([])
    # twice the wanted share by a cheap hash test, then exactly the smallest
    share = {lang: 2 * FIT_DOCS / n for lang, n in counts}
    limit = F.lit(None).cast("double")
    for lang, part in share.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1.0, part))).otherwise(limit)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    some = known.where(place.cast("double") <= limit * float(2**63))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    some = some.withColumn("rank", rank).where(F.col("rank") <= FIT_DOCS)
    windows = some.selectExpr(
        "lang", "rank", "text", f"explode(sequence(0, greatest(0, length(text) - 1) div {WINDOW})) as at"
    ).selectExpr("lang", "rank", "at", f"substring(text, at * {WINDOW} + 1, {WINDOW}) as part")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("lang", "rank", "at"), "rank", "at")
    drawn = windows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= DICTIONARY // WINDOW * 3 // 2)
    parts: dict[str, list[bytes]] = {lang: [] for lang, _ in counts}
    for lang, _, part in sorted(drawn.select("lang", "place", "part").collect()):
        parts[lang].append(letters(part))
    return Model([(lang, b" ".join(parts[lang])[:DICTIONARY] or b" ") for lang, _ in counts])


class Identifier:
    """A model as Spark columns; its dictionaries are bounded and broadcast."""

    def __init__(self, spark: SparkSession, model: Model) -> None:
        content = pickle.dumps(model.dictionaries)
        name, held = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

        def load() -> Model:
            if name not in _loaded:
                _loaded.clear()
                _loaded[name] = Model(pickle.loads(held.value))
            return _loaded[name]

        self.load = load

    def predict(self, text: Column) -> Column:
        """Struct of ``lang_pred``, ``score`` and ``accepted``."""
        load = self.load

        @F.arrow_udf("lang_pred string, score double, accepted boolean")
        def column(texts: pa.Array) -> pa.Array:
            found = [load().predict(x) for x in texts.to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            arrays = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
            return pa.StructArray.from_arrays(arrays, ["lang_pred", "score", "accepted"])

        return column(text)


def identified(docs: DataFrame, divisor: int = 4, value: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every row.

    ``und`` with score 0, not accepted, if a text is null or has no letter, or nothing was learned.
    Equal encodings go to the language with more documents, then the smaller name, with score 0.5,
    and are not accepted. Repeated rows give repeated results; a null doc_id is not held out; other
    columns than doc_id, text and lang are not read; an empty table gives an empty table.
    """
    model = Identifier(docs.sparkSession, fit(docs, divisor, value))
    found = docs.select(
        "doc_id", held_out(F.col("doc_id"), divisor, value).alias("held_out"), model.predict(F.col("text")).alias("found")
    )
    return found.select("doc_id", "held_out", "found.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is told with enough margin; columns stay as they are."""
    model = Identifier(docs.sparkSession, fit(docs))
    return docs.where(model.predict(F.col("text")).accepted)
