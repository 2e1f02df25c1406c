"""Two labellers: agreement, routing, record rules, and the quality checks of the labelling guide.

A sheet has id, labels_a, labels_b and, for the rules, confidence_a/b, notes_a/b and final_labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.labels import LABELS, encode, label_of

# Limits below which a label is flagged, pairs that are rare, and handling routes.
MIN_KAPPA, MIN_F1 = 0.75, 0.70
RARE_PAIRS = (("bezwaar", "zienswijze"), ("woo_verzoek", "informatieverzoek_3_11"))
ROUTES = {
    "aanvraag": "beschikkingsprocedure",
    "bezwaar": "bezwaarprocedure",
    "beroep": "doorzending bestuursrechter",
    "klacht": "klachtprocedure",
    "melding": "operationele afhandeling",
    "zienswijze": "meegewogen bij besluit",
    "woo_verzoek": "woo-procedure",
    "informatieverzoek_3_11": "inzage",
    "vraag_overig": "reguliere correspondentie",
}


def by_label(sheet: DataFrame) -> DataFrame:
    """(label, n, both, only_a, only_b, kappa, f1, flagged): Cohen's kappa and F1 with A as the truth."""
    zipped = F.posexplode(F.arrays_zip(encode(F.col("labels_a")).alias("a"), encode(F.col("labels_b")).alias("b"))).alias("label_id", "c")
    c = sheet.select(zipped).select("label_id", F.col("c.a").alias("a"), F.col("c.b").alias("b"))
    n = c.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if(F.col("a") > F.col("b")).alias("only_a"), F.count_if(F.col("b") > F.col("a")).alias("only_b"))
    seen = (F.col("n") - F.col("only_a") - F.col("only_b")) / F.col("n")
    a, b = (F.col("both") + F.col("only_a")) / F.col("n"), (F.col("both") + F.col("only_b")) / F.col("n")
    chance = a * b + (1 - a) * (1 - b)
    kappa = F.when(chance == 1, 1.0).otherwise((seen - chance) / (1 - chance))
    denominator = F.col("both") * 2 + F.col("only_a") + F.col("only_b")
    f1 = F.when(denominator == 0, 0.0).otherwise(F.col("both") * 2.0 / denominator)
    out = n.select(label_of(F.col("label_id")).alias("label"), "n", "both", "only_a", "only_b", kappa.alias("kappa"), f1.alias("f1"))
    return out.withColumn("flagged", (F.col("kappa") < MIN_KAPPA) | (F.col("f1") < MIN_F1))


def differences(a: Column, b: Column) -> Column:
    return F.size(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def route_disagreement(sheet: DataFrame) -> DataFrame:
    """Add n_differences and route: accept, reviewer or discussion."""
    n = differences(F.col("labels_a"), F.col("labels_b"))
    return sheet.withColumn("n_differences", n).withColumn("route", F.when(n == 0, "accept").when(n == 1, "reviewer").otherwise("discussion"))


def rule_breaks(sheet: DataFrame, labels_col: str = "labels_a", confidence_col: str = "confidence_a", notes_col: str = "notes_a") -> DataFrame:
    """Add breaks: array of the record rules that a row breaks."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    no_labels = F.coalesce(F.size(labels_col) <= 0, F.lit(True))
    unknown = F.size(F.array_except(F.coalesce(labels_col, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in LABELS]))) > 0
    rules = [(F.col("id").isNull(), "id_missing"), (no_labels, "labels_missing"), (unknown, "label_unknown"), (blank(confidence_col), "confidence_missing"), ((F.col(confidence_col) == "laag") & blank(notes_col), "note_missing")]
    return sheet.withColumn("breaks", F.array_compact(F.array(*[F.when(test, name) for test, name in rules])))


def has_rare_pair(labels: Column) -> Column:
    out = F.lit(False)
    for a, b in RARE_PAIRS:
        out = out | (F.array_contains(labels, a) & F.array_contains(labels, b))
    return F.coalesce(out, F.lit(False))


def route_of(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), label)


def route_score(scored: DataFrame, true_col: str = "true_label", pred_col: str = "pred_label", by: tuple[str, ...] = ()) -> DataFrame:
    """(n, n_right, route_score): share of rows whose predicted label leads to the right route."""
    right = F.count_if(route_of(F.col(true_col)) == route_of(F.col(pred_col)))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), right.alias("n_right"), (right / F.count(F.lit(1))).alias("route_score"))

