"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, without loss.

Texts whose words agree but for ASCII capitals and blanks are one node with a SimHash of its
shingles. SimHashes that meet at an anchor (see simhash) are the first candidates. No threshold on
their bits finds all similar texts, though: at a similarity of 0.8 about 10 of 64 bits differ, up to
20, and anchors at such a radius meet everywhere. So a second search by prefixes completes the first.
A node's shingles are put in one global order, and a set of n shingles keeps its first n - ceil(0.8 n) + 1 as its prefix: two
sets that are similar enough share a shingle of both prefixes. The order is that of the hashes, but
shingles that are frequent in a sample come last, so that common passages are in few prefixes; any
order is exact, so the sample decides the cost and no result.

Nodes are compared in three rounds, each by the exact similarity: those that meet at an anchor, and
every node with the least node of each prefix shingle; then, where a shingle's nodes are in several
components still, with HUBS of its nodes whose shingles most others have; then the nodes that share a prefix shingle
and that this left in different components with each other. A large group of near copies is so
linked in the first two rounds and costs no square of its size. Texts whose prefixes share too few
shingles with all others together, as those with a common passage, take no part. A pair goes on to the comparison if
the number of shingles that its prefixes share allows the similarity: what both sets share beyond
them lies outside one and the same prefix. It also has to pass its parities: PARITY_BITS bits of a
node say how many of its shingles fall to each of as many classes, even or odd. Each bit in which two
nodes differ stands for at least one shingle that only one of them has, and a pair of x and y shingles
that is similar enough has no more than (x + y) / 9 of these. The join of the last round tests this
before it makes a pair, so a group of many texts that are near but not near enough to each other makes
no rows for its pairs.

Cases: null and blank texts are one node with no shingles. A text of fewer than five words is one
shingle. Only the text is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import cut, steps_to_one_table

SHINGLE_WORDS = 5
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
#: Texts of which frequent shingles are counted, the count that makes one frequent, and how many are kept.
SAMPLE, FREQUENT, MOST_FREQUENT, SEED = 20_000, 3, 500_000, 7
#: Nodes of a shingle that all its nodes are compared with, where the first round leaves several components.
HUBS = 8
#: Nodes of one shingle beyond which its pairs are dealt to several tasks, and most of these.
SALT_ROWS, MAX_SALTS = 1000, 64
#: Nodes of candidates that may be broadcast to the texts; beyond, the texts are shuffled.
BROADCAST_ROWS = 500_000
#: Bits of a node's parities: 128 bytes, whatever the text's length.
PARITY_BITS = 1024
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i), 5) | 1 for i in range(SHINGLE_WORDS)], dtype=np.uint64)


def _words(text: str | None) -> list[bytes]:
    # bytes.lower() and bytes.split() act on A-Z and on the six ASCII blanks alone
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in words], dtype=np.uint64)
    span = min(SHINGLE_WORDS, len(words))
    n = len(words) - span + 1
    out = np.full(n, span, dtype=np.uint64)
    for o in range(span):
        out += hashes[o : o + n] * _FACTORS[o]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out ^ (out >> np.uint64(29)))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    return _shingles(_words(text))


def _simhash(found: np.ndarray) -> int:
    """64 bits, each that of more than half of the shingles; 0 without shingles."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<i8")[0])


def _parities(found: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits: whether the number of shingles of each class is odd."""
    # the low bits of a hash deal it to a SimHash's count, the next ones to a class
    counts = np.bincount((found >> np.uint64(8)).astype(np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view("<i8")


def _prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the global order (count in the sample, hash)."""
    n = len(found)
    if not n:
        return found
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        found = found[np.argsort(np.where(frequent[at] == found, counts[at], 0), kind="stable")]
    return found[: n + (-NUM * n // DEN) + 1]


def _node_udf(table) -> Callable:
    def nodes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        frequent, counts = table.value
        for texts in batches:
            rows = []
            for text in texts:
                words = _words(text)
                found = _shingles(words)
                node = xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)
                rows.append((node, len(found), _simhash(found), _prefix(found, frequent, counts).view(np.int64), _parities(found)))
            yield pd.DataFrame(rows, columns=["node", "size", "fp", "keys", "odd"])

    return F.pandas_udf(nodes, "node bigint, size int, fp bigint, keys array<bigint>, odd array<bigint>")


def _sampled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


def _frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are frequent in a sample of the texts, and their counts."""
    # rows are drawn one by one, so that a text of many copies is not drawn whole
    texts = docs.select(F.col(text_col).alias("text")).where(F.rand(SEED) * F.lit(max(1.0, docs.count() / SAMPLE)) < 1)
    found = texts.select(F.explode(F.pandas_udf(_sampled, "array<bigint>")("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = found.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toPandas()
    keys, counts = rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def split_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: (doc_id, text_hash, node) of the rows, and the distinct nodes; prefixes stay in the second alone."""
    with steps_to_one_table(docs.sparkSession, keep=2):
        found = cut(nodes(docs, id_col, text_col))
        return cut(found.select("doc_id", "text_hash", "node")), cut(found.select("node", "size", "fp", "keys", "odd").dropDuplicates(["node"]))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, node, size, fp, keys, odd) for each row: its node, number of shingles, SimHash, prefix and parities."""
    table = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text_col))
    text = F.col(text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), _node_udf(table)(text).alias("s"))
    return found.select("doc_id", "text_hash", "s.node", "s.size", "s.fp", "s.keys", "s.odd")


def _set_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


def _are_similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append((NUM + DEN) * both >= NUM * (len(a) + len(b)))
        yield pd.Series(out, dtype=bool)


def _similar(pairs: DataFrame, rows: DataFrame, of: DataFrame, keys: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; what it took to tell is deleted."""
    with steps_to_one_table(docs.sparkSession):
        candidates = cut(_possible(_shared_keys(pairs, of, keys)))
        wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = cut(rows.join(wanted, "node").groupBy("node").agg(F.min("text_hash").alias("text_hash")))
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(wanted, "text_hash")
        sets = texts.select("node", F.pandas_udf(_set_bytes, "binary")("text").alias("set")).dropDuplicates(["node"])
        sets = cut(sets)
        left = candidates.join(sets.select(F.col("node").alias("a"), F.col("set").alias("left")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("right")), "b")
        return cut(both.where(F.pandas_udf(_are_similar, "boolean")("left", "right")).select("a", "b"))


def _possible(met: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes x and y and number n of shared prefix shingles allow the similarity."""
    # the longer set's shingles after its prefix: ceil(0.8 size) - 1
    fits = f"{DEN} * least(x, y) >= {NUM} * greatest(x, y) AND {NUM + DEN} * (n + ({NUM} * greatest(x, y) + {DEN - 1}) div {DEN} - 1) >= {NUM} * (x + y)"
    return met.where(fits).select("a", "b")


def _sizes_allow(x: Column, y: Column) -> Column:
    """True unless sizes alone say that two nodes are not similar."""
    return DEN * F.least(x, y) >= NUM * F.greatest(x, y)


def _near_enough(x: Column, y: Column, odd_x: Column, odd_y: Column) -> Column:
    """True unless sizes or parities say that two nodes are not similar."""
    differ = F.aggregate(F.zip_with(odd_x, odd_y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, b: n + b)
    return _sizes_allow(x, y) & ((NUM + DEN) * differ <= (DEN - NUM) * (x + y))


def _anchored(of: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b, y) of nodes by their SimHashes: the least nodes of linked ones, and every node with the least of its own; y as in _shared_keys."""
    least = cut(of.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")))
    same = of.join(least.where("first <> last").select("fp", "first"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("size").alias("y"))
    met = links(least.select("fp"))
    side = lambda fp, node: least.select(F.col("fp").alias(fp), F.col("first").alias(node))
    pairs = met.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(side("fa", "x"), "fa").join(side("fb", "y"), "fb")
    return same.union(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(None).cast("int").alias("y")))


def _hopeful(shared: DataFrame) -> DataFrame:
    """The rows (key, node, size, ...) of nodes that have enough prefix shingles in common with others to be similar to any.

    Adds `telling`: of a node's shingles in one and the same order, a similar pair shares one of the first so many.

    How many a pair needs (see _possible) grows with the smaller size and falls with the larger, so
    it is least at an end of the sizes met; 1 less allows for rounding.
    """
    each = shared.groupBy("key").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    share, rest = NUM / (NUM + DEN), NUM / DEN
    x, lo, hi = F.col("size"), F.greatest("lo", F.col("size") * NUM / DEN), F.least("hi", F.col("size") * DEN / NUM)
    # the smaller partner, no larger than x, and the larger one, no smaller
    least = F.least(share * (x + F.least(lo, x)) - rest * x, share * (x + F.greatest(hi, x)) - rest * F.greatest(hi, x)) - 1e-6
    met = shared.join(each, "key").groupBy("node", "size").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("c"))
    enough = met.where(F.col("c") >= least).select("node", (F.col("c") - F.greatest(F.lit(1), F.ceil(least)) + 1).alias("telling"))
    return shared.join(cut(enough), "node")


def _shared_keys(pairs: DataFrame, of: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b) that sizes and parities allow, with their sizes x and y and the number n of prefix shingles that both have.

    `pairs` are (a, b) or (a, b, y): y is the size of b or null where it is not known yet. `keys` are (node, keys)
    of the nodes that can be similar to any: those of their prefix shingles that some other node has, too;
    without it, whole prefixes are compared.
    """
    known = F.max("y") if "y" in pairs.columns else F.lit(None).cast("int")
    keys = of.select("node", "keys") if keys is None else keys
    side = lambda node, size, odd: of.select(F.col("node").alias(node), F.col("size").alias(size), F.col("odd").alias(odd))
    met = pairs.groupBy("a", "b").agg(known.alias("known")).join(side("a", "x", "oa"), "a")
    # parities are longer than all else in a pair, so pairs whose sizes rule them out go before these are moved
    met = met.where(F.col("known").isNull() | _sizes_allow(F.col("x"), F.col("known"))).drop("known").join(side("b", "y", "ob"), "b")
    # prefixes grow with their texts, so only pairs that are left carry them
    met = cut(met.where(_near_enough(F.col("x"), F.col("y"), F.col("oa"), F.col("ob"))).select("a", "b", "x", "y"))
    wanted = cut(met.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    keys = cut(keys.join(wanted, "node", "left_semi"))
    both = met.join(keys.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a").join(keys.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b")
    return both.select("a", "b", "x", "y", F.size(F.array_intersect("ka", "kb")).alias("n"))


def similar_pairs(rows: DataFrame, of: DataFrame, docs: DataFrame, links: Callable[[DataFrame], DataFrame], components: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
    """Pairs (a, b) of similar nodes, whose components are those of all similar pairs.

    `rows` are the rows of docs with their nodes, `of` the distinct nodes with sizes, SimHashes, prefixes and
    parities, both written; `links` gives pairs of SimHashes, `components` (node, root) of pairs.
    """
    spark = docs.sparkSession
    with steps_to_one_table(spark, keep=2):
        one = of.select(F.explode("keys").alias("key"), "node", "size")
        # a shingle of one node alone pairs nothing; the least and the greatest node tell
        met = one.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
        met = cut(met.where("first <> last").select("key", "first"))
        shared = cut(_hopeful(cut(one.join(met, "key"))))
        keys = cut(shared.groupBy("node").agg(F.collect_list("key").alias("keys")))
    stars = shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("size").alias("y"))

    def similar(pairs: DataFrame) -> DataFrame:
        return _similar(pairs, rows, of, keys, docs, text_col)

    def across(found: DataFrame) -> DataFrame:
        """(key, node, size, root, n) of the n nodes of each shingle whose nodes are in several components."""
        with steps_to_one_table(spark):
            root = cut(components(found))
            placed = cut(shared.join(root, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")))
            several = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("n")).where("r <> s").select("key", "n")
            return cut(_hopeful(cut(placed.join(cut(several), "key"))))

    first = similar(stars.union(_anchored(of, links)))
    left = across(first)
    # a text whose shingles many others have is the middle of its group, and most similar to the others
    score = left.groupBy("node").agg(F.sum("n").alias("score"))
    hub = F.max(F.struct("score", "node", "root", "size")).alias("hub")
    hubs = left.where(F.col("n") > HUBS).join(cut(score), "node").groupBy("key", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HUBS)).alias("class")).agg(hub)
    hubs = cut(hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root"), F.col("hub.size").alias("hub_size")))
    # a common passage is in texts of all sizes, of which most differ too much
    met = left.join(hubs, "key").where((F.col("root") != F.col("hub_root")) & _sizes_allow(F.col("size"), F.col("hub_size")))
    greater = F.when(F.col("node") > F.col("hub"), F.col("size")).otherwise(F.col("hub_size"))
    second = first.union(similar(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), greater.alias("y"))))
    # rare shingles first; a pair that needs k of them in common cannot have all in either's last k - 1
    rank = F.row_number().over(Window.partitionBy("node").orderBy("n", "key"))
    left = cut(across(second).withColumn("rank", rank).where("rank <= telling").drop("rank"))
    left = left.withColumn("salts", F.least(F.lit(MAX_SALTS), 1 + F.expr(f"n div {SALT_ROWS}")).cast("int"))
    # only here nodes carry their parities, since here all nodes of a key meet
    left = left.join(of.select("node", "odd"), "node")
    one = left.select("key", F.col("node").alias("a"), F.col("size").alias("x"), F.col("root").alias("r"), F.col("odd").alias("oa"), F.expr("cast(pmod(xxhash64(node), salts) AS int)").alias("salt"))
    other = left.select("key", F.col("node").alias("b"), F.col("size").alias("y"), F.col("root").alias("s"), F.col("odd").alias("ob"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    same = one.join(other, (one["key"] == other["key"]) & (one["salt"] == other["salt"]) & (F.col("a") < F.col("b")) & (F.col("r") != F.col("s")) & _near_enough(F.col("x"), F.col("y"), F.col("oa"), F.col("ob")))
    return second.union(similar(same.select("a", "b", "y")))
