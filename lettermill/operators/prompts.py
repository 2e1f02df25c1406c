"""Prompt tables for synthetic letters: grids of label, style and repeat, and chat messages.

The texts below are this library's own; callers may pass tables with theirs. Only labels, style
names and combinations are fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels, the style names and the pairs of labels. The texts are this library's own.
# label: (definition, seed letters, constraints)
LABEL_PROMPTS = {
    "aanvraag": ("De inwoner vraagt de gemeente om iets toe te kennen dat er nog niet is.", ["Graag ontvang ik een parkeervergunning voor mijn nieuwe adres.", "Mag ik subsidie krijgen voor ons buurtfeest in juni?"], ["Noem geen eerder besluit", "Klaag niet over medewerkers"]),
    "bezwaar": ("De inwoner is het oneens met een genomen besluit en wil dat het opnieuw wordt bekeken.", ["Uw besluit om de kap toe te staan klopt niet; kijk er alstublieft nog eens naar."], ["Noem het besluit", "Vraag om een nieuwe beoordeling"]),
    "beroep": ("De inwoner legt een besluit voor aan een hoger orgaan.", ["Ik leg het besluit van de gemeente aan uw college van de provincie voor."], ["Schrijf aan een ander orgaan dan de gemeente", "Noem wie het besluit nam"]),
    "klacht": ("De inwoner is ontevreden over hoe hij of zij is behandeld.", ["Aan de balie werd ik afgesnauwd.", "Niemand belt mij terug, al drie weken niet."], ["Het gaat om gedrag of tempo", "Val de uitkomst van een besluit niet aan"]),
    "melding": ("De inwoner deelt iets mee en vraagt geen besluit.", ["Vanaf maandag is onze winkel open."], ["Vraag niets", "Meld geen kapotte straat"]),
    "zienswijze": ("De inwoner reageert op een plan dat nog niet vaststaat.", ["Over het ontwerp voor het plein wil ik meegeven dat de bomen moeten blijven."], ["Noem het ontwerp of voornemen", "Doe alsof er nog geen besluit is"]),
    "woo_verzoek": ("De inwoner wil dat de overheid documenten openbaar maakt.", ["Op grond van de Woo vraag ik alle stukken over de sporthal op."], ["Vraag om documenten van de overheid", "Vraag niet om het eigen dossier"]),
    "informatieverzoek_3_11": ("De inwoner wil stukken zien die voor een lopend plan ter inzage liggen.", ["Waar kan ik de rapporten bij het ontwerpplan inzien?"], ["Noem de ter inzage gelegde stukken", "Maak er geen Woo-verzoek van"]),
    "vraag_overig": ("Gewone post zonder procedure: een vraag, dank of een idee.", ["Hoe laat gaat de milieustraat dicht?", "Dank voor de hulp bij mijn verhuizing."], ["Vraag geen besluit", "Klaag niet"]),
}
STYLES = {
    "formal_short": "formeel en kort, hoogstens 80 woorden",
    "formal_long": "formeel en uitvoerig, 200 tot 350 woorden, met genummerde punten",
    "informal_short": "losjes en kort, hoogstens 60 woorden",
    "informal_medium": "losjes, 80 tot 150 woorden, een persoonlijk verhaal",
    "angry_medium": "boos, 100 tot 200 woorden, met uitroeptekens",
    "polite_questioning": "beleefd en vragend, 50 tot 100 woorden",
    "nt2_simple": "door iemand die Nederlands leert, zeer korte zinnen",
    "elderly_handwritten_style": "ouderwets en hoffelijk, lange zinnen",
    "legal_dense": "juridisch, namens een cliënt, met wetsartikelen",
    "rambling_long": "uitweidend, 250 tot 450 woorden",
    "chaotic_typing": "haastig getypt, met veel fouten",
}
COMBOS = (
    (("bezwaar", "klacht"), "Maak bezwaar tegen een besluit en klaag over de behandeling."),
    (("aanvraag", "klacht"), "Vraag iets nieuws aan en klaag over een eerdere ervaring."),
    (("aanvraag", "vraag_overig"), "Vraag iets aan en stel er een vraag bij."),
    (("zienswijze", "vraag_overig"), "Reageer op een ontwerp en vraag om meer uitleg."),
)
#: Most rows of a table of styles or labels.
MAX_DIMENSION = 1000
COMBO_STYLES = ("formal_long", "informal_medium", "angry_medium", "rambling_long")


def label_table(spark: SparkSession) -> DataFrame:
    rows = [(label, *LABEL_PROMPTS[label]) for label in LABEL_PROMPTS]
    return spark.createDataFrame(rows, "label string, definition string, examples array<string>, constraints array<string>")


def style_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STYLES.items()), "style string, style_text string")


def combo_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(list(labels), text) for labels, text in COMBOS], "labels array<string>, instruction string")


def _messages(system: Column, user: Column) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", system), ("user", user))])


def _system(style: Column) -> Column:
    return F.concat(F.lit("Je schrijft als inwoner aan de gemeente. Stijl: "), style, F.lit(". Geef alleen de brief."))


def _few(dimension: DataFrame) -> DataFrame:
    """A dimension that may go to every task, after a look at its size."""
    if (n := dimension.limit(MAX_DIMENSION + 1).count()) > MAX_DIMENSION:
        raise ValueError(f"a dimension of prompts has more than {n - 1} rows")
    return F.broadcast(dimension)


def grid(labels: DataFrame, styles: DataFrame, repeats: int) -> DataFrame:
    """label x style x repeat, each with a seed letter of the label picked by a hash of the three.

    The style table is a dimension of few rows, which is checked; each label row is repeated for each style.
    """
    cross = labels.crossJoin(_few(styles)).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    nth = F.pmod(F.xxhash64("label", "style", "repeat"), F.size("examples")).cast("int")
    return cross.withColumn("seed_example", F.get("examples", nth))


def messages(cells: DataFrame) -> DataFrame:
    """Add chat messages to rows with label, definition, constraints, style_text and seed_example."""
    user = F.concat(
        F.lit("Soort brief: "), F.col("label"), F.lit("\nBetekenis: "), F.col("definition"), F.lit("\nVoorbeeld:\n"), F.col("seed_example"),
        F.lit("\nEisen:\n- "), F.array_join("constraints", "\n- "), F.lit("\n- Kies een ander onderwerp dan het voorbeeld"),
    )
    return cells.withColumn("messages", _messages(_system(F.col("style_text")), user))


def combo_grid(combos: DataFrame, styles: DataFrame, labels: DataFrame, repeats: int) -> DataFrame:
    """labels combination x style x repeat with chat messages that define each label."""
    terms = _few(labels).agg(F.map_from_entries(F.collect_list(F.struct("label", "definition"))).alias("_terms"))
    cells = combos.crossJoin(_few(styles)).crossJoin(F.broadcast(terms)).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    lines = F.transform("labels", lambda x: F.concat(F.lit("- "), x, F.lit(": "), F.element_at("_terms", x)))
    user = F.concat(F.lit("Soorten:\n"), F.array_join(lines, "\n"), F.lit("\nOpdracht: "), F.col("instruction"))
    return cells.withColumn("messages", _messages(_system(F.col("style_text")), user)).drop("_terms")
