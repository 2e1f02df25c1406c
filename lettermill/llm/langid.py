"""Language ID with language-bitmask n-gram filters.

Model: one Bloom filter a language, bit-sliced. A slot of the table holds a bitmask of languages,
so ANDing the slots of an n-gram returns all languages that contain it. N-grams are character
trigrams of the lower-cased text in which every non-letter is a blank and the middle is a letter.
A language's filter holds the trigrams whose share of the language's trigrams is at least MIN_SHARE
and at least RATIO times their largest share in any language; shares come from all training texts.
MIN_SHARE bounds the number of trigrams a language to 1 / MIN_SHARE, hence the filter's size.

Decision: with n trigrams, h of them in language l's filter and f the filter's false-positive rate
(fill to the number of hashes), the corrected popcount is max(0, (h - n f) / (1 - f)). The language
with the largest one wins, the first by name among equals. The score is its share of n.

Cases: null texts and texts without a letter are `und` with score 0, as is every text if nothing
was learned. Null languages are not learned from. Texts of any length are read whole, in pieces
of CHUNK characters. Repeated rows give repeated rows; an empty table an empty result. All languages
are learned, however many. The model holds the slots that are not empty, 14 bytes for each of these and every 64
languages; from it a task makes a table of 8 bytes a slot for every 64 languages, 8 MB. Of more than
TABLE_LANGUAGES languages a task has the table of so many at a time, 128 MB, and compares a batch of
texts with one table after the other. Only id, text and language are read; further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lettermill.llm.common import cut, packed

MIN_SHARE = 1e-5
RATIO = 0.1
SLOTS = 1 << 20
HASHES = 3
#: Languages of one table, a multiple of 64. A model of more has several, of which a task holds one at a time.
TABLE_LANGUAGES = 1024
CHUNK = 1 << 18
#: Trigrams that a task counts before it hands them on.
FLUSH = 1 << 21
UND = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def trigrams(text: str) -> np.ndarray:
    """The text's trigrams, packed into 63 bits each, in order."""
    letter = _is_letter()
    padded = f" {text.lower()} "
    out = []
    for at in range(0, len(padded) - 2, CHUNK):
        # a piece overlaps the next by two characters, so each trigram is met once
        c = np.frombuffer(padded[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        is_letter = letter[c]
        c[~is_letter] = 32
        grams = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        out.append(grams[is_letter[1:-1]])
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    """HASHES slot numbers for each trigram."""
    x = grams.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return [((x >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def counted() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": n.astype(np.int64)})
        held.clear()

    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            grams = trigrams(text)
            held.setdefault(lang, []).append(grams)
            size += len(grams)
            if size >= FLUSH:
                yield from counted()
                size = 0
    yield from counted()


@dataclass
class Model:
    languages: list[str]
    #: Languages of a table.
    width: int
    #: For each table its slots that are not empty, the word of 64 languages, and the languages that hold the slot.
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    false_rate: np.ndarray

    def tables(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number of the first language, and slots x words of 64 languages, of each table."""
        for k, (slot, word, mask) in enumerate(self.parts):
            first = k * self.width
            table = np.zeros((SLOTS, (min(self.width, len(self.languages) - first) + 63) // 64), dtype=np.uint64)
            table[slot, word] = mask
            yield first, table

    def popcounts(self, text: str, first: int, table: np.ndarray) -> tuple[int, np.ndarray]:
        """Number of trigrams, and the corrected count of those in each language of a table."""
        false_rate = self.false_rate[first : first + self.width]
        n, hits = 0, np.zeros(len(false_rate))
        grams = trigrams(text)
        for at in range(0, len(grams), CHUNK):
            part = grams[at : at + CHUNK]
            masks = np.bitwise_and.reduce([table[s] for s in _slots(part)])
            n += len(part)
            for i in range(len(hits)):
                hits[i] += np.count_nonzero(masks[:, i // 64] & np.uint64(1 << i % 64))
        return n, np.maximum(0.0, (hits - n * false_rate) / (1 - false_rate))

    def predict_all(self, texts: Iterable[str | None], tables: Iterable[tuple[int, np.ndarray]]) -> list[tuple[str, float]]:
        texts = list(texts)
        best = [(-1.0, UND, 0.0)] * len(texts)
        for first, table in tables:
            for j, text in enumerate(texts):
                n, counts = self.popcounts(text, first, table) if text else (0, None)
                if n:
                    i = int(np.argmax(counts))
                    # languages are in order of their names, so the first of equals stays
                    if counts[i] > best[j][0]:
                        best[j] = float(counts[i]), self.languages[first + i], float(min(1.0, counts[i] / n))
        return [x[1:] for x in best]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text], self.tables())[0]


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows with text and language. What reaches the driver is the model: at most SLOTS rows for every 64 languages."""
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInPandas(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    found = sorted((r.lang, r.total) for r in totals.collect())
    languages = [lang for lang, _ in found]
    if not languages:
        return Model([], TABLE_LANGUAGES, [], np.zeros(0))
    totals = train.sparkSession.createDataFrame([(lang, i, total) for i, (lang, total) in enumerate(found)], "lang string, i int, total bigint")
    # as many rows as the model has languages
    shares = counts.join(F.broadcast(totals), "lang").select("gram", "i", (F.col("n") / F.col("total")).alias("share"))
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    held = shares.where(F.col("share") >= MIN_SHARE).join(top, "gram").where(F.col("share") >= RATIO * F.col("top"))
    masks = held.select("gram", F.expr("cast(i div 64 as int)").alias("word"), F.expr("shiftleft(1L, i % 64)").alias("bit")).groupBy("gram", "word").agg(F.bit_or("bit").alias("mask"))
    slots = masks.mapInPandas(_spread, "slot bigint, word int, mask bigint").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    slot, word, mask = slots["slot"].to_numpy(np.int32), slots["word"].to_numpy(np.int32), slots["mask"].to_numpy(np.int64).view(np.uint64)
    words, fill, parts = TABLE_LANGUAGES // 64, np.zeros(len(languages)), []
    for k in range(0, (len(languages) + 63) // 64, words):
        mine = (word >= k) & (word < k + words)
        parts.append((slot[mine], (word[mine] - k).astype(np.int16), mask[mine]))
        for w in range(words):
            of = parts[-1][2][parts[-1][1] == w]
            for i in range(64 * (k + w), min(64 * (k + w + 1), len(languages))):
                fill[i] = np.count_nonzero(of & np.uint64(1 << i % 64)) / SLOTS
    return Model(languages, TABLE_LANGUAGES, parts, np.minimum(fill**HASHES, 0.999))


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for slots in _slots(batch["gram"].to_numpy(np.int64)):
            yield pd.DataFrame({"slot": slots, "word": batch["word"].to_numpy(), "mask": batch["mask"].to_numpy()})


def predictor(df: DataFrame, model: Model):
    """A column function text -> struct(lang, score). The model is broadcast; see above for its size."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        # one table serves all batches of a task; several are made anew for each batch, so that one is held at a time
        only = list(model.tables()) if len(model.parts) == 1 else None
        for texts in batches:
            yield pd.DataFrame(model.predict_all(texts, only or model.tables()), columns=["lang", "score"])

    out = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])
    return F.pandas_udf(predict, out)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of the ids that are kept from training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; learns from the rows that are not held out."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    predict = predictor(docs, model)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs in a learned language; those without a language (`und`) go. All columns stay, whatever their names."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    predict = predictor(docs, model)
    return packed(docs, lang=predict(F.col(text_col))["lang"]).where(F.col("lang") != UND).select("row.*")
