"""Datasets: unions, resume, distributions, funnels, splits and the metadata report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.once import packed
from lettermill.functions.ranks import group_ranks
from lettermill.functions.storage import cut

NONE = "__none__"
#: Labels are a closed set; more than this are a column that holds something else.
MAX_LABELS = 10_000


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unseen(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is not among the existing rows, once a key. Null keys stay."""
    return new.dropDuplicates([key]).join(existing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def label_distribution(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    """(label, n) by count, then name."""
    return df.select(F.explode(labels_col).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def source_distribution(df: DataFrame, source_col: str = "source") -> DataFrame:
    return df.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def funnel(df: DataFrame, by: tuple[str, ...] = (), **steps: Column) -> DataFrame:
    """One pass: the number of rows and, for each named condition, of the rows that meet it."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in steps.items()])


def domain_check(df: DataFrame, col: str, allowed: DataFrame, allowed_col: str) -> DataFrame:
    """Fail if a value of col is outside the dimension; else df."""
    bad = df.select(F.col(col).alias("v")).where("v is not null").distinct().join(allowed.select(F.col(allowed_col).alias("v")), "v", "left_anti")
    if first := bad.limit(5).collect():
        raise ValueError(f"unknown {col}: {', '.join(str(r.v) for r in first)}")
    return df


def _check(train: float, val: float) -> None:
    if not 0 < train + val < 1:
        raise ValueError("the train and validation shares must add up to a number between 0 and 1")


def rarest_label(df: DataFrame, labels_col: str = "labels") -> Column:
    """The row's rarest label over df, the first in the row among equals; NONE without labels.

    Counts are one number a label of a closed set, so they travel as a constant.
    """
    counts = {r.label: r.n for r in label_distribution(df, labels_col).limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not counts:
        return F.lit(NONE)
    table = F.create_map(*[x for label, n in sorted(counts.items()) for x in (F.lit(label), F.lit(n))])
    each = F.transform(labels_col, lambda label, i: F.struct(F.element_at(table, label), i, label.alias("label")))
    return F.coalesce(F.array_min(each)["label"], F.lit(NONE))


def _split(df: DataFrame, bucket: Column, id_col: str, train: float, val: float, seed: int) -> DataFrame:
    """Cut every bucket by rank in the order of (md5(id|seed), id).

    Only buckets and keys are ranked. The rows where val and test begin, two a bucket, are then
    what each row's key is compared with, so texts are neither shuffled nor sorted. Rows that
    repeat an id fall on the same side.
    """
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    rows = df.withColumn("bucket", bucket).withColumn("_at", F.struct(key.alias("key"), F.col(id_col).alias("id")))
    keys = rows.select("bucket", F.col("_at.key").alias("key"), F.col("_at.id").alias("id"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    n_train, n_val = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(val))
    ranked = group_ranks(keys, "bucket", "key", ["id"], "rank").join(sizes, "bucket")
    begins = lambda rank: F.max(F.when(F.col("rank") == rank, F.struct("key", "id")))
    cuts = ranked.where((F.col("rank") == n_train) | (F.col("rank") == n_train + n_val)).groupBy("bucket").agg(begins(n_train).alias("_val"), begins(n_train + n_val).alias("_test"))
    # read back as a table, one row a bucket, the cuts have a known size and are broadcast if that is small
    placed = rows.join(cut(cuts), "bucket")
    split = F.when(F.col("_at") >= F.col("_test"), "test").when(F.col("_at") >= F.col("_val"), "val").otherwise("train")
    return placed.withColumn("split", split).drop("_at", "_val", "_test")


def stratified_split(df: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42, id_col: str = "id", labels_col: str = "labels") -> DataFrame:
    """Add bucket (the row's rarest label) and split."""
    _check(train, val)
    return _split(df, rarest_label(df, labels_col), id_col, train, val, seed)


def random_split(df: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42, id_col: str = "id") -> DataFrame:
    _check(train, val)
    return _split(df, F.lit("all"), id_col, train, val, seed).drop("bucket")


def external_split(df: DataFrame, test: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42, stratified: bool = True, id_col: str = "id", labels_col: str = "labels") -> DataFrame:
    """train and val from df in their proportion, test from elsewhere; rounding leftovers go to val."""
    ratio = train / (train + val)
    make = stratified_split if stratified else random_split
    parts = make(df, ratio, 1 - ratio - 1e-6, seed, id_col, **({"labels_col": labels_col} if stratified else {}))
    parts = parts.withColumn("split", F.when(F.col("split") == "test", "val").otherwise(F.col("split")))
    return union_all(parts, test.withColumn("split", F.lit("test")))


def hash_sample(df: DataFrame, share: float, id_col: str = "id", seed: int = 42) -> DataFrame:
    """A repeatable sample for manual checks: rows whose id hashes below the share."""
    digits = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double")
    return df.where(digits < share * 16**8)


def metadata_report(split: DataFrame, labels_col: str = "labels", source_col: str = "source") -> DataFrame:
    """One row: sizes of the splits, and maps of label and source counts, gathered in one pass."""
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    entries = F.concat(F.array(entry("split", F.col("split")), entry("source", F.col(source_col))), F.transform(F.coalesce(labels_col, F.array().cast("array<string>")), lambda x: entry("label", x)))
    long = split.select(F.explode(entries).alias("e")).groupBy("e.kind", "e.key").agg(F.count(F.lit(1)).alias("n"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    as_map = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("key").isNotNull(), F.struct("key", "n")))))
    is_split = F.col("kind") == "split"
    return long.agg(total(is_split)("n_total"), *[total(is_split & (F.col("key") == s))(f"n_{s}") for s in ("train", "val", "test")], as_map("label").alias("label_distribution"), as_map("source").alias("source_distribution"))


def sample_by_label(df: DataFrame, k: int, id_col: str = "id", labels_col: str = "labels", seed: int = 42) -> DataFrame:
    """(label, nth, *columns of df): for each label, and for rows without one, the k rows with the smallest hashes of their id.

    Exact sizes: k, or all rows of a rarer label; a row with several labels is drawn for each by itself.
    A row's place depends on its id and the seed alone, so samples of parts can be merged into that of
    the whole. Tasks keep their own k smallest before the shuffle (a window with a limit on its rank is
    cut in the tasks), so a label's task sees k rows a task, whatever the label's size. Among equal hashes
    the smaller id comes first.
    """
    has = F.coalesce(F.col(labels_col), F.array().cast("array<string>"))
    label = F.explode(F.when(F.size(has) == 0, F.array(F.lit(NONE))).otherwise(F.array_distinct(has)))
    each = packed(df, label=label, key=F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))), id=F.col(id_col))
    first = each.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("key", "id"))).where(F.col("nth") <= k)
    return first.select("label", "nth", "row.*")
