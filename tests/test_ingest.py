"""Catalog and council pages, labelled JSON lines, generated text, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from lettermill.functions import text as T
from lettermill.operators import prompts
from lettermill.sources import catalog, council, examples, sinks


def pages(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "page_no int, page string")


def test_catalog(spark, tmp_path):
    full = {"id": "1", "name": "n", "title": "t", "organization": {"title": "", "name": "org"}, "notes": "x" * 400, "resources": [{"format": " JSON", "url": "u1", "name": "a"}, {"format": "PDF"}, {"format": None}, {}]}
    docs = [{"success": True, "result": {"results": [full, {"id": "2", "resources": None}, {"id": "3", "organization": {"title": "T", "name": "x"}}]}}, {"success": False, "result": {"results": [{"id": "9"}]}}, "kapot", None]
    got = {r.id: r for r in catalog.summarize(catalog.datasets(pages(spark, *docs))).collect()}
    assert set(got) == {"1", "2", "3"}
    r = got["1"]
    assert (r.organization, len(r.notes_excerpt), r.n_resources_total, r.n_resources_machine_readable) == ("org", 300, 4, 1)
    assert r.all_resource_formats == ["", " json", "pdf"] and [tuple(x) for x in r.machine_readable_urls] == [(" json", "u1", "a")]
    assert (got["2"].n_resources_total, got["2"].notes_excerpt, got["2"].organization, got["3"].organization) == (0, "", None, "T")
    (tmp_path / "p.json").write_text(json.dumps(docs[0]))
    assert catalog.datasets(catalog.read_pages(spark, str(tmp_path))).count() == 3


def test_council(spark):
    def hit(i, index="ori_den_haag_2024", **source):
        return {"_id": i, "_index": index, "_score": 1.5, "_source": source}

    first = {"hits": {"hits": [hit("a", name="Ingekomen brief", text=[" een ", "", None, "twee"], url="u", file_name="x.pdf"), hit("b", name="n", text="  tekst ", file_name="BRIEF.pdf", original_url="o")]}}
    second = {"hits": {"hits": [hit("a", name="later"), hit("c", index="other", name="Presentatie brief van inwoner", text=None), hit("d", name="x", text="de burgerbrieven", file_name="f")]}}
    found = council.hits(pages(spark, second | {}, first).withColumn("page_no", 1 - F.col("page_no")))
    got = {r.id: r for r in council.documents(found).collect()}
    assert (got["a"].text, got["a"].gemeente, got["a"].text_length, got["a"].name, got["a"].url, got["a"].length_verdict) == ("een\n\ntwee", "den_haag", 9, "Ingekomen brief", "u", "too_short")
    assert (got["b"].text, got["b"].url, got["c"].text, got["c"].gemeente) == ("tekst", "o", "", None)
    assert {r.id: r.match_count for r in council.citizen_letters(found).collect()} == {"a": 1, "b": 1}
    assert {r.id for r in council.citizen_letters(found, extra=["burgerbrieven"]).collect()} == {"a", "b", "d"}


@pytest.mark.parametrize("name, want", [("ori_aalsmeer_20250410", "aalsmeer"), ("ori_den_haag_2025", "den_haag"), ("ori_x", None), ("osi_x_1", None), ("", None), (None, None)])
def test_municipality(spark, name, want):
    assert spark.createDataFrame([(name,)], "v string").select(T.municipality(F.col("v"))).first()[0] == want


@pytest.mark.parametrize("n, want", [(199, "too_short"), (200, "kept"), (20_000, "kept"), (20_001, "too_long")])
def test_length_bounds(spark, n, want):
    assert spark.createDataFrame([("x" * n,)], "v string").select(council.length_reason(F.col("v"))).first()[0] == want


GOOD = {"id": "1", "text": "brief", "source": "gold", "labels": ["klacht"]}


def test_labelled_lines(spark, tmp_path):
    bad = [GOOD | {"labels": ["onbekend"]}, GOOD | {"text": 5}, GOOD | {"source": "krant"}, {k: v for k, v in GOOD.items() if k != "id"}, GOOD | {"confidence": "zeker"}, GOOD | {"labels": "klacht"}, GOOD | {"pseudonymized": "ja"}, GOOD | {"created_at": "ooit"}, [1]]
    good = [GOOD, GOOD | {"id": "2", "labels": [], "confidence": "laag", "notes": None, "created_at": "2024-01-02T03:04:05Z", "extra": 1}, {k: v for k, v in GOOD.items() if k != "labels"}]
    (tmp_path / "a.jsonl").write_text("\n".join(["", *map(json.dumps, good), "  ", "{kapot"]))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, bad)))
    kept, rejects = examples.read_examples(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"))
    rows = kept.collect()
    assert [(r.id, r.labels, r.language, r.pseudonymized) for r in sorted(rows, key=lambda r: (r.id, r.labels))] == [("1", [], "nl", False), ("1", ["klacht"], "nl", False), ("2", [], "nl", False)]
    assert rejects.count() == len(bad) + 1 and rows[0].file_path.endswith("a.jsonl")
    assert [r.labels.index(1.0) for r in examples.training_rows(kept).collect() if 1.0 in r.labels] == [3]


CLEAN = [
    ("```text\nGeachte heer\n```", "Geachte heer"),
    ('"Hallo daar"', "Hallo daar"),
    ("Brief: Tekst: inhoud", "inhoud"),
    ("Tekst: Brief: inhoud", "Brief: inhoud"),
    ("hier is mijn bericht: dag", "dag"),
    ("a\n\n\n\nb", "a\n\nb"),
    ("  x \u001c", "x"),
    ("''\"x\"''", "\"x\""),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("raw, want", CLEAN)
def test_clean_generated(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "v string").select(T.clean_generated(F.col("v"))).first()[0] == want


@pytest.mark.parametrize("text, ok", [("x" * 30, True), ("x" * 29, False), ("x" * 4001, False), ("Ik kan u niet helpen met het schrijven van deze brief.", False), ("ZEKER, hier komt de brief die u vroeg, beste mensen.", False), ("", False), (None, False)])
def test_valid_generation(spark, text, ok):
    assert spark.createDataFrame([(text,)], "v string").select(T.is_valid_generation(F.col("v"))).first()[0] is ok


def test_prompt_grids(spark):
    labels, styles = prompts.label_table(spark), prompts.style_table(spark)
    cells = prompts.messages(prompts.grid(labels, styles, 2))
    assert cells.count() == 9 * 11 * 2
    r = cells.where("label = 'klacht' and style = 'nt2_simple' and repeat = 1").first()
    assert [m.role for m in r.messages] == ["system", "user"] and r.seed_example in r.examples and r.seed_example in r.messages[1].content and r.style_text in r.messages[0].content
    combos = prompts.combo_grid(prompts.combo_table(spark), styles.where(F.col("style").isin(*prompts.COMBO_STYLES)), labels, 4)
    assert combos.count() == 4 * 4 * 4 and "- klacht: " in combos.where(F.array_contains("labels", "klacht")).first().messages[1].content
    made = examples.from_generation(spark.createDataFrame([("tekst", ["bezwaar", "klacht"], "s")], "text string, labels array<string>, style string"), "m").first()
    assert made.notes == "multilabel; style=s; model=m" and made.pseudonymized is False


def test_sinks_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    sinks.append_rows(df, f"{tmp_path}/a")
    sinks.append_rows(df, f"{tmp_path}/a")
    assert spark.read.json(f"{tmp_path}/a").count() == 4
    sinks.overwrite_rows(df, f"{tmp_path}/a")
    assert spark.read.json(f"{tmp_path}/a").count() == 2
    sinks.save_splits(df, f"{tmp_path}/s")
    assert {r.split for r in spark.read.json(f"{tmp_path}/s").collect()} == {"train", "test"}
    with pytest.raises(ValueError):
        sinks.save_redacted(df, df, f"{tmp_path}/x", f"{tmp_path}/x/")
    sinks.save_redacted(df, df, f"{tmp_path}/x", f"{tmp_path}/y")
    sinks.save_report(df.where("id = 1"), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first().split == "train"
    (tmp_path / "b.json").write_text(json.dumps({"model_path": "m", "evaluations": {"e1": {"default": {"macro_f1": 0.5, "note": "x"}, "n_examples": 3}}}, indent=1))
    assert [(r.eval_set, r.family, r.metric, r.value) for r in sinks.read_reports(spark, str(tmp_path / "b.json")).collect()] == [("e1", "default", "macro_f1", 0.5)]


def test_short_names(spark):
    df = spark.createDataFrame([("runs/model-a/bench.json",), ("bench.json",)], "p string")
    assert [tuple(r) for r in df.select(T.parent_folder(F.col("p")), T.file_name(F.col("p"))).collect()] == [("model-a", "bench.json"), (None, "bench.json")]
