"""Importance resampling towards a target: bag-of-n-gram log ratios and a Gumbel draw without replacement.

Features of a text are its runs of 1 to max_n consecutive words, hashed to buckets by crc32. A bucket's
gain is the log ratio of its share in the target's texts to its share in all documents, in thousandths.
A document's weight is the sum of its features' gains; weight plus Gumbel noise from a hash of its id,
sorted, is a draw without replacement with odds exp(weight / 1000).

Tokens stay in Arrow: ascii_lower, split_pattern_regex, list_flatten and dictionary_encode give
dictionary indices; an index beside the next one is a pair, distinct pairs are the n-grams, and only
these get a checksum, which goes on from the shorter n-gram's. `take` maps positions to gains and a
segment sum adds them up for each text.

State: two arrays of one number a bucket (the corpus's counts and the target's), summed within tasks
first and collected, since their size is the parameter `buckets`. A task holds a piece of about
PIECE_BYTES of texts at a time, or one text that is longer.

Cases: null texts have no features and weight 0. A null id is hashed as the empty word; among equal
scores it precedes others. Rows equal in score and id are ranked one after the other. Documents of
under min_words words are scored and not drawn. An empty target gives every document gains of a
target without features; an empty table gives an empty result. Only id and text are read; further
columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.ranks import group_ranks
from lettermill.llm.common import cut, packed, steps_to_one_table

#: What separates words: ASCII characters other than digits and lower-case letters.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE_BYTES = 1 << 23


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of about PIECE_BYTES, with the number of rows before them."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // PIECE_BYTES
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(texts)], strict=True):
        yield int(a), texts.slice(a, b - a)


def features(texts: pa.Array, max_n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the row and the bucket of every run of n words, in order."""
    words = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SPLIT)
    rows, flat = pc.list_parent_indices(words), pc.list_flatten(words)
    there = pc.not_equal(flat, "")
    rows, encoded = rows.filter(there).to_numpy(), flat.filter(there).dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    index = encoded.indices.to_numpy().astype(np.int64)
    vocabulary = [w.encode() for w in encoded.dictionary.to_pylist()]
    crc = np.fromiter((zlib.crc32(w) for w in vocabulary), dtype=np.int64, count=len(vocabulary))
    gram = index
    yield rows, pc.take(pa.array(crc % buckets), pa.array(gram)).to_numpy()
    for n in range(1, max_n):
        # position i holds the run of n words that starts there; its next word is n positions on, if still in the same row
        m = max(0, len(rows) - n)
        fits = rows[:m] == rows[n:]
        pairs, each = np.unique(gram[:m][fits] * len(vocabulary) + index[n:][fits], return_inverse=True)
        crc = np.fromiter((zlib.crc32(b" " + vocabulary[p % len(vocabulary)], int(crc[p // len(vocabulary)])) for p in pairs.tolist()), dtype=np.int64, count=len(pairs))
        yield rows[:m][fits], pc.take(pa.array(crc % buckets), pa.array(each)).to_numpy()
        gram = np.zeros(m, dtype=np.int64)
        gram[fits] = each


def bucket_counts(df: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket. A task adds up its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, piece in _pieces(batch.column(0)):
                for _, found in features(piece, max_n, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = df.select(F.col(text_col)).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each of the B buckets."""
    b = len(corpus)
    ratio = (target + 1.0) * (corpus.sum() + b) / ((corpus + 1.0) * (target.sum() + b))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


@dataclass(frozen=True)
class Settings:
    max_n: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: int = 2024


def _scorer(df: DataFrame, gain: np.ndarray, s: Settings):
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def score(texts: pa.Array) -> pa.Array:
        count, words, weight = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        values = pa.array(shared.value)
        for at, piece in _pieces(texts):
            for n, (rows, found) in enumerate(features(piece, s.max_n, s.buckets), 1):
                each = pc.take(values, pa.array(found)).to_numpy()
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                if not len(starts):
                    continue
                lengths = np.diff(np.append(starts, len(rows)))
                count[at + rows[starts]] += lengths
                weight[at + rows[starts]] += np.add.reduceat(each, starts)
                if n == 1:
                    words[at + rows[starts]] += lengths
        return pa.StructArray.from_arrays([pa.array(count), pa.array(words), pa.array(weight)], names=["n_features", "n_words", "weight"])

    return F.arrow_udf(score, "struct<n_features:bigint,n_words:bigint,weight:bigint>")


def _noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(row, n_features, n_words, weight, score) for each row of docs; `row` is the row itself."""
    s = settings
    gain = gains(bucket_counts(docs, text_col, s.max_n, s.buckets), bucket_counts(target, target_text_col, s.max_n, s.buckets))
    score = _scorer(docs, gain, s)
    rows = packed(docs).withColumn("found", score(F.col(f"row.`{text_col}`")))
    return rows.select("row", "found.*").withColumn("score", (F.col("weight") + _noise(F.col(f"row.`{id_col}`"), s.seed)).cast("long"))


def plan(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; rows that are not drawn have no rank.

    Scores are written once; only ids and numbers are sorted, in ranges (functions/ranks.py).
    """
    with steps_to_one_table(docs.sparkSession):
        rows = scored(docs, target, id_col, text_col, target_text_col, settings)
        rows = cut(rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), "n_features", "n_words", "weight", "score"))
        fit = F.col("n_words") >= settings.min_words
        drawn = rows.where(fit).count() * settings.percent // 100
        ranked = group_ranks(rows.where(fit).withColumns({"all": F.lit(0), "down": -F.col("score")}), "all", "down", ["doc_id"], "before")
        rank = F.when(F.col("before") < drawn, F.col("before") + 1)
        kept = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
        return cut(ranked.select(*kept, rank.alias("rank")).unionByName(rows.where(~fit).select(*kept, F.lit(None).cast("long").alias("rank"))))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The drawn rows of docs with all their columns, without a shuffle of texts: rows down to the last drawn one's score and id.

    Rows that share the last one's score and id all come.
    """
    ranked = plan(docs, target, id_col, text_col, target_text_col, settings)
    last = ranked.where("rank is not null").select(F.max_by(F.struct("score", "doc_id"), "rank").alias("last")).first()["last"]
    rows = scored(docs, target, id_col, text_col, target_text_col, settings)
    if last is None:
        return rows.where(F.lit(False)).select("row.*")
    kind = docs.schema[id_col].dataType
    key = F.col(f"row.`{id_col}`")
    low = F.lit(last["doc_id"]).cast(kind)
    tied = key.isNull() if last["doc_id"] is None else key.isNull() | (key <= low)
    return rows.where((F.col("n_words") >= settings.min_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tied))).select("row.*")
