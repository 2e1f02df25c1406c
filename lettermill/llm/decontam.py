"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and underscores of the lower-cased text; in scripts without blanks
(Han, kana, Thai, Lao, Burmese, Khmer) each character is a word. A document overlaps a benchmark item
if, at some alignment, WINDOW consecutive words agree with the item in all but at most
MAX_SUBSTITUTIONS places. A shorter item must occur as a whole, with substitutions in proportion to
its length (one from 7 words on). Items of under MIN_WORDS words, which anybody may write, match the
documents that consist of them.

Seeds: the positions of a window with s substitutions are dealt into s + 2 runs, and a mask looks at
two of them (in general, ignores s), so for any places of the substitutions some mask ignores them
all and its hash agrees. A document position is first looked up run by run, then under each mask
whose runs all passed, in a Bloom filter of the benchmark's hashes (two bits set of BITS_PER_HASH a
hash; MAX_FILTER_BITS, 32 MB, is its largest size, and a fuller filter lets more through and loses
nothing); those that pass are joined with the benchmark's hashes and the words around the hit are
compared one by one.

Cases: null and blank texts have no words, match nothing and stay. An item is matched by each of
its rows. Documents are told apart by id and text: those that share an id, or have none, have rows of
their own, and a row that is given twice counts once. An empty benchmark or corpus gives no overlaps.
Texts of any length are read whole, in pieces of CHUNK starts. Only ids and texts are read, so
further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lettermill.llm.common import cut, packed, steps_to_one_table

WINDOW = 13
MAX_SUBSTITUTIONS = 2
MIN_WORDS = 5
BITS_PER_HASH = 64
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 24, 1 << 28
#: Rows of benchmark hashes that may be broadcast; beyond, the join shuffles on salted hashes.
BROADCAST_ROWS = 200_000
#: Hits of one hash beyond which the shuffled join deals them to several tasks.
SALT_ROWS = 20_000
#: Starts of windows that are looked up at a time.
CHUNK = 1 << 17
#: Rows that a task hands on at a time, and words whose hashes it remembers.
FLUSH, REMEMBERED = 20_000, 1 << 20

# The blocks of scripts that are written without blanks.
UNSPACED = (("0e00", "0eff"), ("1000", "109f"), ("1780", "17ff"), ("3040", "30ff"), ("3400", "4dbf"), ("4e00", "9fff"), ("f900", "faff"), ("00020000", "0003ffff"))
_RANGES = "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in UNSPACED)
_TOKEN = re.compile(rf"[^\W{_RANGES}]+|(?=\w)[{_RANGES}]")
_BITMAP_BYTES = 4096  # of one group of Spark's bitmap functions
_SCHEMA = "id string, text_key bigint, pos int, key bigint, words array<bigint>"
_COLUMNS = ["id", "text_key", "pos", "key", "words"]


def substitutions(span: int) -> int:
    """How many words of a window of `span` words may differ."""
    return span * MAX_SUBSTITUTIONS // WINDOW


def runs(span: int = WINDOW) -> list[tuple[int, ...]]:
    """The runs of neighbouring offsets that a window is dealt into; one where no word may differ."""
    n = substitutions(span)
    return [tuple(map(int, run)) for run in np.array_split(np.arange(span), n + 2 if n else 1)]


def masks(span: int = WINDOW) -> list[tuple[int, ...]]:
    """Numbers of the runs that each mask looks at."""
    return list(combinations(range(substitutions(span) + 2), 2)) if substitutions(span) else []


def _number(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name, 7) | 1)


_FACTORS = np.array([_number(str(i)) for i in range(WINDOW)], dtype=np.uint64)


class _Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_hashes(text: str | None, hashes: dict | None = None) -> np.ndarray:
    words = _TOKEN.findall((text or "").lower())
    return np.fromiter(map((_Hashes() if hashes is None else hashes).__getitem__, words), dtype=np.uint64, count=len(words))


def _lengths(texts: pd.Series) -> pd.Series:
    return pd.Series([len(_TOKEN.findall((t or "").lower())) for t in texts], dtype="int32")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sums(words: np.ndarray, offsets: tuple[int, ...], n: int) -> np.ndarray:
    """A number for the words at the offsets of each of n starts."""
    out = np.zeros(n, dtype=np.uint64)
    for o in offsets:
        out += words[o : o + n] * _FACTORS[o]
    return out


class _Filter:
    """Bits of the benchmark's hashes; without bits everything passes."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def _is_set(self, x: np.ndarray) -> np.ndarray:
        at = (x & np.uint64(len(self.bits) * 8 - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def passing(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys whose two bits are set. Few pass the first test and need the second."""
        if self.bits is None:
            return np.arange(len(keys))
        first = np.flatnonzero(self._is_set(keys))
        return first[self._is_set(keys[first] >> np.uint64(32))]


#: For each span, its runs with the numbers that their hashes start from, and its masks with theirs.
_RUNS = {span: [(run, _number(f"{span} run {run}")) for run in runs(span)] for span in range(1, WINDOW + 1)}
_MASKS = {span: [(i, j, _number(f"{span} mask {i} {j}")) for i, j in masks(span)] for span in range(1, WINDOW + 1)}


def _hits(words: np.ndarray, span: int, held: _Filter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, keys) of the windows of `span` words that pass, under each mask, or under their one run."""
    n = len(words) - span + 1
    if n <= 0:
        return
    sums, passed = [], []
    for run, number in _RUNS[span]:
        sums.append(_sums(words, run, n))
        keys = _mix(sums[-1] + number)
        at = held.passing(keys)
        if not _MASKS[span]:
            yield at, keys[at]
            return
        passed.append(np.zeros(n, dtype=bool))
        passed[-1][at] = True
    for i, j, number in _MASKS[span]:
        both = np.flatnonzero(passed[i] & passed[j])
        keys = _mix(sums[i][both] + sums[j][both] + number)
        at = held.passing(keys)
        yield both[at], keys[at]


def _run_keys(words: np.ndarray) -> np.ndarray:
    """The run hashes of an item's windows, for the filter."""
    span = min(len(words), WINDOW)
    if not span:
        return np.empty(0, dtype=np.uint64)
    return np.concatenate([_mix(_sums(words, run, len(words) - span + 1) + number) for run, number in _RUNS[span]])


def _groups(batch: pd.DataFrame, hashes: dict) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, word hashes of their texts one after another, ends of the texts in these) for texts of CHUNK words and more together."""
    ids, words, ends = [], [], []
    for row_id, text_key, text in zip(batch["id"], batch["text_key"], batch["text"], strict=True):
        words += _TOKEN.findall((text or "").lower())
        ids.append((row_id, text_key))
        ends.append(len(words))
        if len(words) >= CHUNK:
            yield ids, np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)), np.array(ends)
            ids, words, ends = [], [], []
    if words:
        yield ids, np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)), np.array(ends)


def _windows(spans: list[int], passes=None):
    """Rows of the seeds of each text; `passes` gives the filter, where only its hits are wanted. Without, all of an item's.

    The texts of a group are looked up as one; windows that reach into the next text are left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, hashes = _Filter(None if passes is None else passes.value), _Hashes()
        out: list[tuple] = []
        for batch in batches:
            for ids, words, ends in _groups(batch, hashes):
                lengths = np.diff(ends, prepend=0)
                for span in spans:
                    for at in range(0, len(words) - span + 1, CHUNK):
                        for starts, keys in _hits(words[at : at + CHUNK + span - 1], span, held):
                            starts = starts + at
                            text = np.searchsorted(ends, starts, side="right")
                            whole = starts + span <= ends[text]
                            if span < MIN_WORDS or (passes is None and span < WINDOW):
                                whole &= lengths[text] == span  # a short item stands for itself only, and the shortest match whole texts
                            first = starts - ends[text] + lengths[text]
                            for i, t, pos, key in zip(starts[whole].tolist(), text[whole].tolist(), first[whole].tolist(), keys[whole].view(np.int64).tolist(), strict=True):
                                out.append((*ids[t], pos, key, words[i : i + span].view(np.int64)))
                                if len(out) >= FLUSH:
                                    yield pd.DataFrame(out, columns=_COLUMNS)
                                    out = []
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return rows


def _all_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The run hashes of benchmark items."""
    hashes = _Hashes()
    for batch in batches:
        for text in batch["text"]:
            yield pd.DataFrame({"key": _run_keys(word_hashes(text, hashes)).view(np.int64)})


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """Bitmap of n benchmark hashes. Spark builds it in groups; the driver puts them side by side."""
    bits = MIN_FILTER_BITS
    while bits < BITS_PER_HASH * n and bits < MAX_FILTER_BITS:
        bits *= 2
    both = F.array("key", F.shiftrightunsigned("key", 32))
    spot = F.col("x").bitwiseAND(F.lit(bits - 1)) + 1
    parts = keys.select(F.explode(both).alias("x")).select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        start = (r.bucket - 1) * _BITMAP_BYTES
        out[start : start + _BITMAP_BYTES] = np.frombuffer(bytes(r.bitmap), dtype=np.uint8)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word, most_equal): each document-item overlap.

    Words are numbered from 0; most_equal is the best window's number of equal words.
    """
    found = _overlaps(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")))
    return found.drop("text_key")


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The overlaps with the hash of the document's text. Ids travel as strings, so those of any type keep their digits."""
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    texts = lambda df, c: df.select(F.col(c).cast("string").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    items = texts(benchmark, "item_id")
    count = F.pandas_udf(_lengths, IntegerType())
    lengths = sorted(r.n for r in items.select(count("text").alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct().collect())
    spans = [WINDOW, *lengths]
    seeds = cut(items.mapInPandas(_windows(spans), _SCHEMA))
    keys = cut(seeds.select("key").union(items.mapInPandas(_all_keys, "key bigint")).distinct())
    n = seeds.count()
    passes = docs.sparkSession.sparkContext.broadcast(_filter(keys, keys.count()))
    hits = texts(docs, "doc_id").mapInPandas(_windows(spans, passes), _SCHEMA)
    hits = hits.select(F.col("id").alias("doc_id"), "text_key", "pos", "key", "words")
    seeds = seeds.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "key", F.col("words").alias("item_words"))
    if n <= BROADCAST_ROWS:
        met = hits.join(F.broadcast(seeds), "key")
    else:
        hits = cut(hits)
        # fewer than one row for every SALT_ROWS hits
        hot = cut(hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALT_ROWS).select("key", F.expr(f"cast(1 + n div {SALT_ROWS} AS int)").alias("salts")))
        salted = seeds.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        dealt = hits.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        met = dealt.join(salted, ["key", "salt"])
    equal = F.aggregate(F.zip_with("words", "item_words", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    span = F.size("words")
    allowed = F.floor(span * MAX_SUBSTITUTIONS / F.lit(WINDOW))
    met = met.where(span == F.size("item_words")).withColumn("equal", equal).where(F.col("equal") >= span - allowed)
    return met.groupBy("doc_id", "text_key", "item_id").agg(
        F.count_distinct("pos", "item_pos").alias("n_windows"),
        F.min("pos").cast("long").alias("first_word"),
        F.max(F.col("pos") + span - 1).cast("long").alias("last_word"),
        F.max("equal").cast("long").alias("most_equal"),
    ).withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text overlaps no benchmark item; all columns stay, whatever their names.

    Rows are told apart by a hash of their text, which is never null, so the id plays no part.
    """
    key = F.xxhash64(F.col(text_col))
    with steps_to_one_table(docs.sparkSession):
        texts = docs.select(F.lit(None).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
        dirty = cut(_overlaps(texts, benchmark.select("item_id", "text")).select(F.col("text_key").alias("dirty")).distinct())
    rows = packed(docs, text_key=key)
    return rows.join(dirty, F.col("text_key") == F.col("dirty"), "left_anti").select("row.*")
