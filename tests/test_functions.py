"""Column functions on literals, and the readers and sinks."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from plaza.functions import harm, hashing, scores, text
from plaza.sources import sinks
from plaza.sources.tables import first_present, read_csv, read_csv_glob, read_json_documents, read_json_tree, read_jsonl, text_columns_with


def value(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.squeeze, "  a \n\t b  ", "a b"),
        (lambda c: text.shorten(c, 10), "abcdefghijkl", "abcdefg..."),
        (lambda c: text.preview(c, 3), "abcd", "abc..."),
        (text.plain_punctuation, "“Hi”!!! it’s — ok", '"Hi"! it\'s - ok'),
        (text.ascii_words, "né à Paris", "n Paris"),
        (text.escape_html, "<a href='x'>&", "&lt;a href=&#x27;x&#x27;&gt;&amp;"),
        (text.strip_leftovers, "hi <LBL:BENIGN> there ```json", "hi < there"),
        (text.clean_brackets, "a [Style: x] b [short] c [this one is long enough here]", "a b c this one is long enough here"),
        (lambda c: F.array_join(text.label_tokens(c), ","), "x <LBL:A_B> LBL:CD y", "LBL:A_B,LBL:CD"),
        (lambda c: F.array_join(text.issues(c), ","), "<LBL:X> ```", "unimputed_label_token,bracketed_label_token,json_markdown_block"),
        (lambda c: text.persona_prefix(c, ["misinfo", "alpha"]), "Alpha_00012", "alpha"),
        (lambda c: F.array_join(harm.categories(harm.counts(c)), ","), "nice day", "benign"),
        (lambda c: F.array_join(harm.categories(harm.counts(c)), ","), "wake up sheeple", "conspiracy,misinfo"),
        (lambda c: harm.action(harm.categories(harm.counts(c))), "race war", "intervene"),
        (harm.spectrum, "hate kill destroy", "explicit_hate"),
        (harm.spectrum, "sunny", "neutral"),
    ],
)
def test_text_functions(spark, f, given, want):
    assert value(spark, f(F.col("c")), c=given) == want


@pytest.mark.parametrize("f", [text.squeeze, text.plain_punctuation, text.strip_leftovers, text.escape_html])
def test_text_functions_on_null_and_empty(spark, f):
    assert value(spark, f(F.col("c")), c=None) is None
    assert value(spark, f(F.col("c")), c="") == ""


@pytest.mark.parametrize("n", [1, 7, 13, 100, 2**30])
def test_hash_choices_equal_big_integers(spark, n):
    for key in ("a", "7:12:LBL:X:0", "é"):
        assert value(spark, hashing.md5_choice(F.col("c"), n), c=key) == int(hashlib.md5(key.encode()).hexdigest(), 16) % n
        assert value(spark, hashing.sha_choice(F.col("c"), n), c=key) == int(hashlib.sha256(key.encode()).hexdigest(), 16) % n


def test_seed32(spark):
    assert value(spark, hashing.seed32(F.lit("1"), F.col("c")), c="x") == int(hashlib.sha256(b"1:x").hexdigest()[:8], 16)


def test_hot_score_order(spark):
    rows = [("1", 100000, 25, dt.datetime(2024, 6, 25, 12)), ("2", 90, 30, dt.datetime(2024, 6, 26, 12)), ("3", 75, 50, dt.datetime(2024, 6, 27, 12)), ("4", 70, 50, dt.datetime(2024, 6, 27, 13))]
    df = spark.createDataFrame(rows, "id string, a int, b int, t timestamp_ntz")
    top = [r.id for r in df.orderBy(scores.hot_score(F.col("a"), F.col("b"), F.col("t")).desc()).limit(3).collect()]
    assert set(top) == {"3", "4", "1"}


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(scores.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] is None
    assert got[1] == pytest.approx(1.0)


def test_csv_and_json_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", ["x", "y/z"]), (2, "é", ["x"])], "id int, t string, labels array<string>")
    sinks.write_csv(df.select("id", "t"), f"{tmp_path}/csv")
    assert {tuple(r) for r in read_csv(spark, f"{tmp_path}/csv", "id int, t string").collect()} == {(1, "a,b"), (2, "é")}
    sinks.write_jsonl(df, f"{tmp_path}/json")
    assert read_jsonl(spark, f"{tmp_path}/json", "id int, t string").count() == 2
    sinks.write_parquet(df, f"{tmp_path}/pq")
    assert spark.read.parquet(f"{tmp_path}/pq").count() == 2
    sinks.write_by_label(df, "labels", f"{tmp_path}/by")
    assert sorted(p.name for p in (tmp_path / "by").glob("label=*")) == ["label=x", "label=y_z"]
    sinks.write_by_split(df.select("id", "t"), "t", f"{tmp_path}/split")
    assert len(list((tmp_path / "split").glob("t=*"))) == 2


def test_jsonl_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    assert {r.id for r in read_jsonl(spark, f"{tmp_path}/x.jsonl", "id int").collect()} == {1, 2}
    bad = read_jsonl(spark, f"{tmp_path}/x.jsonl", "id int", keep_bad=True).filter("_corrupt_record IS NOT NULL")
    assert [r._corrupt_record for r in bad.collect()] == ["not json"]


def test_json_documents_and_trees(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    assert read_json_documents(spark, f"{tmp_path}/a.json", "id int").count() == 2
    for event, label in (("fire", "rumour"), ("flood", "true")):
        at = tmp_path / "tree" / event / label
        at.mkdir(parents=True)
        (at / "t.json").write_text('{"id": 3}')
    got = read_json_tree(spark, f"{tmp_path}/tree", "id int", r"/tree/([^/]+)/([^/]+)/")
    assert {(r.id, r.event, r.label) for r in got.collect()} == {(3, "fire", "rumour"), (3, "flood", "true")}


def test_csv_glob(spark, tmp_path):
    (tmp_path / "hate_cats_1k.csv").write_text("t\nx\n")
    (tmp_path / "hate_dogs_1k.csv").write_text("t\ny\n")
    got = read_csv_glob(spark, f"{tmp_path}/hate_*.csv", "t string", r"hate_(.+)_1k\.csv")
    assert {(r.t, r.demographic) for r in got.collect()} == {("x", "cats"), ("y", "dogs")}


def test_column_probes(spark):
    df = spark.createDataFrame([(1, "a <LBL:X>", "b"), (2, None, "c")], "id int, p string, q string")
    assert [r[0] for r in text_columns_with(df, "<LBL:").collect()] == ["p"]
    assert df.select(first_present(df, ["zz", "q"]).alias("v")).first().v == "b"
    assert df.select(first_present(df, ["zz"]).alias("v")).first().v is None
