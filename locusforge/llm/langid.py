"""Language identification by compression.

For each language a bounded sample of texts becomes a raw-content dictionary of zstandard: whole texts with the least
hashes, cut into pieces, of which those with the least hashes fill the dictionary. A text is compressed with
every dictionary, piece by piece so that the dictionary counts throughout; the smallest result names the language.
Narrow margins are rejected: `rejected` is true, the guess stays in lang_pred.

Edge cases: null texts and texts without a letter are `und` with score 0; where no language was learned every text is
`und`; ties go to the language with more rows, then by name; a text of any length is read whole, piece by piece, and a repeated one
is learned once; lang, source, doc_id and all other columns, whatever their names, play no part in a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

UNKNOWN = "und"
PIECE = 1024  # bytes compressed at once
PIECES = 4096  # of a language at most, where many are short
LEVEL = 6
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased words of letters alone; empty if the text has none."""
    return _OTHER.sub(" ", text.lower()).strip().encode()


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 by 4. False for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, *, sample_rows: int = 1000, languages: int = 64, dictionary_bytes: int = 112_640) -> list[tuple[str, bytes]]:
    """(language, dictionary), most rows first.

    Bounds of the sample: the most frequent languages, sample_rows distinct texts of each, dictionary_bytes of their pieces.
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = rows.select("lang", F.xxhash64("text").alias("h"), "text").withColumn("u", F.pmod("h", F.lit(1 << 30)))
    counts = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return []
    spark = docs.sparkSession
    # A cut by hash leaves some twice the sample, whatever the rows, so that few are ranked.
    cuts = F.broadcast(spark.createDataFrame([(r.lang, min(1 << 30, (2 * sample_rows << 30) // max(1, r.texts) + 1)) for r in counts], "lang string, cut long"))
    some = hashed.select("lang", "u", "h").join(cuts, "lang").where("u < cut").select("lang", "u", "h").distinct()
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))).where(F.col("r") <= sample_rows)
    chosen = shared.materialize(ranked.select("lang", "h"), "sample")
    texts = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = pieces(letters(batch.column(1)[i].as_py()))
                named = pa.array([batch.column(0)[i].as_py()] * len(found), pa.string())
                yield pa.RecordBatch.from_arrays([named, pa.array([place(x) for x in found], pa.int64()), pa.array(found, pa.binary())], ["lang", "g", "piece"])

    in_order = Window.partitionBy("lang").orderBy("g", "piece")
    dealt = texts.mapInArrow(cut, "lang string, g long, piece binary").distinct().withColumn("r", F.row_number().over(in_order)).where(F.col("r") <= PIECES)
    full = F.sum(F.length("piece")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    picked = dealt.withColumn("before", F.coalesce(full, F.lit(0))).where(F.col("before") < dictionary_bytes).select("lang", "g", "piece").collect()  # dictionary_bytes a language
    by: dict[str, list[tuple[int, bytes]]] = {}
    for r in picked:
        by.setdefault(r.lang, []).append((r.g, bytes(r.piece)))
    return [(r.lang, b"\n".join(x for _, x in sorted(by.get(r.lang, [])))[:dictionary_bytes]) for r in counts]


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def place(piece: bytes) -> int:
    """A signed hash, in whose order pieces are taken."""
    return xxhash.xxh64_intdigest(piece) - (1 << 63)


class Classifier:
    def __init__(self, languages: list[tuple[str, bytes]], level: int = LEVEL):
        self.names = [k for k, _ in languages]
        self.packers = []
        for _, data in languages:
            known = zstandard.ZstdCompressionDict(data or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the share of bytes that the best saves against the second best."""
        raw = letters(text) if text is not None and self.names else b""
        if not raw:
            return UNKNOWN, 0.0
        parts = pieces(raw)
        sizes = np.array([sum(len(p.compress(x)) for x in parts) for p in self.packers])
        best = int(sizes.argmin())
        second = int(np.delete(sizes, best).min()) if len(sizes) > 1 else int(sizes[best]) + 1
        return self.names[best], float(min(1.0, max(0.0, 1 - sizes[best] / second)))


def identify_language(docs: DataFrame, *, margin: float = 0.02, **sample: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (score below the margin)."""
    spark = docs.sparkSession
    shared.prepare(spark)
    languages = spark.sparkContext.broadcast(learn(docs, **sample))  # dictionary_bytes a language
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(languages.value)
        for batch in batches:
            found = [classifier.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([s < margin for _, s in found], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(classify, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, rejected boolean")
