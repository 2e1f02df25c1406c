"""SimHash near-dedup by anchor-point covering.

Each text gets a 64-bit SimHash over its 3-word shingles. Fingerprints that differ in at most 3
bits are linked and linked documents form components.

Candidate search: parts of the fingerprint are cut out so that two fingerprints that differ in at
most 3 bits differ in at most 1 bit of one part. The anchors of a part are a covering code: the
Hamming code of length 31 times the part's other, free bits. Every part lies within 1 bit of exactly
one anchor (its home), so a part that differs from it in at most 1 bit lies within 1 + 1 = 2 bits of
that anchor. Each fingerprint is put at these anchors around its parts and compared there with the
fingerprints at home there. No link is missed. Two cuts: the two halves, 34 anchors a fingerprint
out of 2^27 a half; or any 3 of 5 blocks, which of 3 differing bits hold at most 1, 240 anchors out of
2^34 a part. Both find the same links. n fingerprints are put at n * 34 or n * 240 anchors and meet
n^2 * 34 / 2^27 or n^2 * 240 / 2^34 others by chance, so the second is taken from 2^29 on.

Cases: null, empty and blank texts have fingerprint 0 and are linked like any others. Equal
fingerprints are one node, so copies cost nothing. Repeated rows and repeated ids each give a row.
A null doc_id is ignored by the minimum (component_id is null if a component has no id). An empty
table gives an empty result. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lettermill.llm import neardup
from lettermill.llm.common import cut, packed, steps_to_one_table

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Shingles hashed before their bits are counted; bounds memory for very long texts.
CHUNK = 1 << 16
_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _count_bits(hashes: list[int]) -> np.ndarray:
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS_OF_BYTE for i in range(8)])


def fingerprint(text: str | None) -> int:
    """SimHash of a text as an unsigned 64-bit number."""
    # bytes.lower() and bytes.split() act on A-Z and on the six ASCII blanks alone
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(SHINGLE_WORDS, len(words)) - 1
    starts, ends = starts[: len(words) - last].tolist(), ends[last:].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, n, CHUNK):
        counts += _count_bits([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a signed 64-bit SimHash of each row's whole text."""
    udf = F.pandas_udf(_fingerprints, LongType())
    return docs.select(F.col(id_col).alias("doc_id"), udf(F.col(text_col)).alias("fp"))


#: Parts are made of blocks (first bit, bits). Halves, and 3 of 5 blocks.
HALVES = (((0, 32),), ((32, 32),))
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TRIPLES = tuple(combinations(_BLOCKS, 3))
#: Distinct fingerprints from which parts of more bits cost less.
MANY = 1 << 29


def _part(blocks: tuple[tuple[int, int], ...]) -> Column:
    out, at = F.lit(0).cast("long"), 0
    for first, bits in blocks:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)), at))
        at += bits
    return out


def _syndrome(part: Column) -> Column:
    """Position (1..31) of the bit to flip for the nearest Hamming code word, 0 for a code word."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        out = out + F.bit_count(part.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * F.lit(1 << j)
    return out.cast("int")


_FLIP = "shiftleft(1L, {} - 1)"
_HOME = f"if(s = 0, v, v ^ {_FLIP.format('s')})"
#: Anchors within 2 bits of v that may be home to what differs in 1: its home, that with a free bit flipped, and two flips that cancel the syndrome.
_NEAR = f"""concat(array({_HOME}), transform(sequence(32, bits), i -> ({_HOME}) ^ {_FLIP.format('i')}),
    if(s = 0, cast(array() as array<bigint>),
       transform(filter(sequence(1, 31), i -> i < (i ^ s)), i -> v ^ {_FLIP.format('i')} ^ {_FLIP.format('(i ^ s)')})))"""


def _parts(fps: DataFrame, cuts: tuple) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i).alias("h"), F.lit(sum(n for _, n in blocks)).alias("bits"), _part(blocks).alias("v")) for i, blocks in enumerate(cuts)])
    return fps.select("fp", F.explode(parts).alias("x")).select("fp", "x.*").withColumn("s", _syndrome(F.col("v")))


def links(fps: DataFrame, cuts: tuple | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most MAX_BITS bits."""
    cuts = cuts or (HALVES if fps.count() < MANY else TRIPLES)
    parts = _parts(fps, cuts)
    home = parts.select(F.col("fp").alias("a"), F.expr(f"h * {1 << 40}L + ({_HOME})").alias("anchor"))
    near = parts.select(F.col("fp").alias("b"), "h", F.explode(F.expr(_NEAR)).alias("c")).select("b", F.expr(f"h * {1 << 40}L + c").alias("anchor"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return home.join(near, (home["anchor"] == near["anchor"]) & close).select("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): connected components of pairs (a, b) by alternating large and small stars.

    Both star steps are a group minimum and a join on the node; the edge table is written to the
    shared folder after each round. Rounds grow with the logarithm of the longest chain.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id reachable."""
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    root = components(links(nodes.select("fp")))
    linked = root.select(F.col("node").alias("fp"), "root").union(root.select(F.col("root").alias("fp"), "root").distinct())
    linked = cut(linked.join(nodes, "fp"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(least, "root").select("fp", "least_id", F.lit(True).alias("is_linked"))
    named = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("least_id")).otherwise(F.col("first_id")).alias("component_id"))
    # as a table of its own the naming does not tie the join's partitions, and a large group of copies can be split
    named = cut(named)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of texts with a five-word Jaccard similarity of 0.8 or more; all columns stay, whatever their names.

    Rows are judged by their text, so rows without an id are linked like others. That with the
    smallest doc_id stays (an id before none, then the smallest text hash), and once if repeated.
    SimHashes of five-word shingles give the first candidates; the search that completes them and
    the exact comparison are in neardup.
    """
    with steps_to_one_table(docs.sparkSession):
        rows, of = neardup.split_nodes(docs, id_col, text_col)
        root = components(neardup.similar_pairs(rows, of, docs, links, components, text_col))
        # as a table of its own the naming has a known size and does not tie the join's partitions
        root = cut(root)
        placed = rows.select("doc_id", "text_hash", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
        keeper = F.xxhash64("doc_id", "text_hash")
        keepers = placed.groupBy("root").agg(best.alias("k")).select(F.xxhash64("k.doc_id", "k.text_hash").alias("keeper")).distinct()
        # most rows stay, so those that go, and those that repeat, are the shorter list
        told = rows.groupBy(keeper.alias("keeper")).agg(F.count(F.lit(1)).alias("n")).join(keepers.withColumn("stays", F.lit(True)), "keeper", "left")
        told = cut(told.where("n > 1 OR stays IS NULL").select("keeper", F.coalesce("stays", F.lit(False)).alias("stays")))
    if told.count() <= neardup.BROADCAST_ROWS:
        told = F.broadcast(told)
    keyed = packed(docs, keeper=F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))))
    lone = keyed.join(told, "keeper", "left_anti").select("row")
    # a row that repeats, however often, is picked within each task first
    repeated = keyed.join(told.where("stays"), "keeper", "left_semi").groupBy("keeper").agg(F.first("row").alias("row")).select("row")
    return lone.union(repeated).select("row.*")
