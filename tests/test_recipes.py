import pytest
from pyspark.sql import functions as F

from grainmill.constants import BASE_WEIGHTS, CPT_WEIGHTS
from grainmill.operators import mixture, recipes
from grainmill.sources import tables
from grainmill.sources.corpus_text import tokenizer_corpus, write_documents, write_lines

RAW = "source string, ord bigint, head string, tail string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


@pytest.mark.parametrize(
    "recipe, source, shortest",
    [("base", "openwebmath", 101), ("cpt", "wikipedia", 200), ("cpt", "bookcorpus", 100), ("cpt", "tinystories", 50)],
)
def test_length_edges_count_stripped_code_points(spark, recipe, source, shortest):
    lengths = [49, 50, 99, 100, 101, 199, 200]
    rows = [(source, n, "\n " + "é" * n + "　 ", None) for n in lengths]
    got = recipes.prepare(raw(spark, rows), recipe).select("ord").collect()
    assert sorted(r["ord"] for r in got) == [n for n in lengths if n >= shortest]


def test_formats(spark):
    rows = [
        ("tinystories", 1, " once \n", None), ("metamathqa", 2, " q ", " r "), ("gsm8k", 3, "q", "a"),
        ("arc", 4, "which", "x y"), ("openwebmath", 5, "  " + "w" * 101 + " ", None), ("unknown", 6, "x", None),
    ]
    base = {r["source"]: r["text"] for r in recipes.prepare(raw(spark, rows), "base").collect()}
    assert base == {
        "tinystories": "<|problem|>Continue the story:<|step|> once \n<|end|>",
        "metamathqa": "<|problem|> q <|step|> r <|end|>",
        "gsm8k": "<|problem|>q<|step|>a<|end|>",
        "arc": "<|problem|>which<|step|>x y<|end|>",
        "openwebmath": "<|problem|>Reason through this:<|step|>" + "w" * 101 + "<|end|>",
    }
    long = [(s, 1, " " + "t" * 250 + "\n", None) for s in ("tinystories", "wikipedia", "bookcorpus")]
    cpt = {r["source"]: r["text"] for r in recipes.prepare(raw(spark, long + rows[1:3]), "cpt").collect()}
    assert cpt == {
        **{s: "t" * 250 + "<|end|>" for s in ("tinystories", "wikipedia", "bookcorpus")},
        "metamathqa": "q\nr<|end|>", "gsm8k": "q\na<|end|>",
    }


def test_null_fields_are_rejected_and_counted(spark):
    rows = [("metamathqa", 1, "q", None), ("metamathqa", 2, "q", "r"), ("tinystories", 3, None, None), ("tinystories", 4, "t", None)]
    df = raw(spark, rows)
    assert {r["ord"] for r in recipes.prepare(df, "base").collect()} == {2, 4}
    assert {(r["source"], r["n_rejected"]) for r in recipes.rejects(df, "base").collect()} == {("metamathqa", 1), ("tinystories", 1)}


@pytest.mark.parametrize("cap, loose, exact", [(0, 1, 1), (1, 2, 1), (3, 4, 3), (9, 5, 5)])
def test_caps(spark, cap, loose, exact):
    rows = [(s, i, "h", "t") for s in ("gsm8k", "arc") for i in range(5)]
    got = {r["source"]: r["count"] for r in recipes.prepare(raw(spark, rows), "base", cap=cap).groupBy("source").count().collect()}
    assert got == {"gsm8k": loose, "arc": exact}
    clean = recipes.prepare(raw(spark, rows), "base", cap=cap, compat=False)
    assert clean.count() == 2 * min(cap, 5)


def test_weights_keep_order_and_sum_to_one(spark):
    for name, pairs in (("base", BASE_WEIGHTS), ("cpt", CPT_WEIGHTS)):
        got = recipes.weights(spark, name).orderBy("pos").collect()
        assert [(r["name"], r["weight"]) for r in got] == pairs
        assert abs(sum(w for _, w in pairs) - 1) < 1e-9
    clean = [r["name"] for r in recipes.weights(spark, "cpt", compat=False).orderBy("pos").collect()]
    assert clean[2] == "bookcorpus"


def test_budgets_truncate_like_float_arithmetic(spark):
    w = spark.createDataFrame([(0, "a", 0.29), (1, "b", 0.3)], "pos int, name string, weight double")
    got = mixture.budgets(w, 100).orderBy("pos").collect()
    assert [r["budget"] for r in got] == [int(100 * 0.29), int(100 * 0.3)] == [28, 30]


def test_unknown_sources_are_skipped_not_redistributed(spark):
    b = mixture.budgets(recipes.weights(spark, "cpt"), 1000)
    docs = mixture.attach_budget(
        spark.createDataFrame([("gsm8k", 1, "x" * 10)], "source string, ord bigint, text string"), b
    )
    kept = mixture.budget_prefix(docs, F.octet_length("text"))
    report = {r["source"]: r for r in mixture.build_report(b, recipes.registry(spark, "cpt"), kept).collect()}
    assert report["bookscorpus"]["status"] == report["arc"]["status"] == "skipped"
    assert report["gsm8k"]["status"] == "exhausted" and report["gsm8k"]["shortfall"] == 40
    assert report["bookscorpus"]["budget"] == 250
    assert len(report) == 6


def test_registered_source_takes_part(spark):
    before = recipes.RECIPES["base"]
    try:
        recipes.register_source("base", "notes", recipes.SourceRule(lambda h, t: F.upper(h), recipes.at_least(2)), 0.1)
        got = recipes.prepare(raw(spark, [("notes", 1, "ab", None), ("notes", 2, "c", None)]), "base").collect()
        assert [r["text"] for r in got] == ["AB"]
        assert recipes.weights(spark, "base").where("name = 'notes'").count() == 1
    finally:
        recipes.RECIPES["base"] = before


def test_config_and_split_prune_folders(spark, tmp_path):
    df = spark.createDataFrame(
        [("ARC-Challenge", "train", 1, "q"), ("ARC-Easy", "train", 2, "q"), ("ARC-Easy", "test", 3, "q")],
        "config string, split string, ord bigint, question string",
    )
    df.write.partitionBy("config", "split").parquet(str(tmp_path / "arc"))
    got = tables.scan(spark, str(tmp_path / "arc"), config="ARC-Easy", split="train")
    assert [r["ord"] for r in got.collect()] == [2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(config" in plan


def test_scan_json_with_nested_choices(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"ord": 1, "question": "q", "choices": {"text": ["a", "b c"]}}\n')
    got = tables.scan(spark, str(tmp_path / "q.json"), tables.CHOICE_SCHEMA, fmt="json")
    row = tables.raw_rows(got, "arc", "question", tables.choices_text(), 1).first()
    assert (row["ord"], row["tail"]) == ((1 << 40) + 1, "a b c")


def test_tokenizer_corpus_takes_first_rows_and_first_config_only(spark):
    rows = [("metamathqa", i, f"q{i}", "r\nr") for i in range(5)]
    rows += [("arc", i, "q", "") for i in range(3)] + [("arc", (1 << 40) + 9, "easy", "x"), ("wikipedia", 1, "no", None)]
    got = tokenizer_corpus(raw(spark, rows), [("metamathqa", 2), ("arc", None)]).orderBy("src_pos", "ord").collect()
    assert [(r["src_pos"], r["ord"], r["line"]) for r in got] == [
        (0, 0, "q0 r r"), (0, 1, "q1 r r"), (1, 0, "q "), (1, 1, "q "), (1, 2, "q "),
    ]


def test_text_files(spark, tmp_path):
    df = spark.createDataFrame([(" a\nb ",), ("  ",), ("c",)], "text string").coalesce(1)
    write_documents(df, str(tmp_path / "docs"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "docs").glob("part-*")))
    assert written == "a\nb\n\nc\n\n"
    write_lines(spark.createDataFrame([("a\nb\rc",)], "line string"), str(tmp_path / "lines"))
    assert "".join(p.read_bytes().decode() for p in (tmp_path / "lines").glob("part-*")) == "a b\rc\n"
