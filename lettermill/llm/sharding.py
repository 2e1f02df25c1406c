"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the least -ln(u) / weight, where u in (0, 1) comes from
md5(key ':' shard). The choice depends on the key and the shards alone (law `key`); a further
shard takes records from the others and moves none between them.

Within a shard, slots number the records from 0 in the order of md5(key). Counts of hash ranges
give the offsets, so no task sorts a whole shard.

Cases: a null text has no bytes (size 1) and crc32 0. A null key hashes as the empty string. Rows
with equal keys share a shard and are told apart by text checksum and size; wholly equal rows take
neighbouring slots in either order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.ranks import group_ranks

SHARDS = (1.0,) * 8
_DIGITS = 13  # hex digits of md5 that fit a double exactly


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard number for a key column under the weights, one for each shard; a weight of 0 shuts a shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for i, w in enumerate(weights):
        if w <= 0:
            continue
        digits = F.substring(F.md5(F.concat(text, F.lit(f":{i}")).cast("binary")), 1, _DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
        scores.append(F.struct((-F.ln(u) / float(w)).alias("s"), F.lit(i).alias("i")))
    return F.array_min(F.array(*scores))["i"]


def assign(docs: DataFrame, weights: Sequence[float] = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) for each row; grown: one more shard of the mean weight.

    With keep_columns, the other columns of docs follow. One that has the name of a column above, in
    any case, is called `own_<name>`, with as many further `own_` as make the name new. The counts
    need ids only; the rows themselves are shuffled once, to be numbered.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    grown = [*weights, sum(weights) / len(weights)]
    own = {
        "doc_id": F.col(id_col),
        "size": (F.octet_length(data) + 1).cast("long"),
        "text_crc32": F.crc32(data),
        "shard": shard_of(F.col(id_col), weights),
        "grown_shard": shard_of(F.col(id_col), grown),
    }
    out = [*own, "slot"]
    others: dict[str, str] = {}
    taken = set(out) | {c.lower() for c in docs.columns}
    for c in docs.columns if keep_columns else []:
        if c == id_col:
            continue
        name = c
        while name.lower() in out or (name != c and name.lower() in taken):
            name = f"own_{name}"
        others[name] = c
        taken.add(name.lower())
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    kept = F.struct(*[F.col(f"`{c}`").alias(name) for name, c in others.items()]) if others else F.lit(None)
    rows = docs.select(*[c.alias(n) for n, c in own.items()], key.alias("key"), kept.alias("others"))
    placed = group_ranks(rows, "shard", "key", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard", *(["others.*"] if others else []))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = SHARDS, id_col: str = "doc_id") -> None:
    """Write docs as Parquet, one folder a shard; each task writes to all shards it has rows of."""
    docs.withColumn("shard", shard_of(F.col(id_col), weights)).write.partitionBy("shard").parquet(path)
