import pytest
from pyspark.sql import functions as F

from duoglot.config import CorpusConfig
from duoglot.operators.corpus import build_corpus, deduplicate
from duoglot.plans.ingest import ingest_csv
from duoglot.sources import corpus as source

RAW = "book_id string, para_id string, pali_text string, translation_paragraph string, note string, old_ascii string"


def test_columns_keys_and_dedup(spark):
    raw = spark.createDataFrame([
        ("b", "1", " pāli ", "one", "x", "q"), ("b", "1", "pāli", "one", "y", "q"),
        ("b", "1", "pāli", "two", "z", "q"), ("b", None, None, "three", "n", "q")], RAW)
    rows = build_corpus(raw).orderBy("doc_id", "translation_paragraph").collect()
    assert "old_ascii" not in rows[0].asDict()
    assert [(r["doc_id"], r["pali_paragraph"], r["translation_paragraph"], r["note"],
             r["multilingual_concat"]) for r in rows] == [
        ("b:1", "pāli", "one", "x", "pāli \n one"), ("b:1", "pāli", "two", "z", "pāli \n two"),
        ("b:nan", None, "three", "n", " \n three")]


def test_ascii_columns(spark):
    raw = spark.createDataFrame([("b", "1", "pāli", "Été", "x", "q")], RAW)
    row = build_corpus(raw, CorpusConfig(ascii_columns=True)).first()
    assert (row["pali_paragraph_ascii"], row["pali_text_ascii"],
            row["translation_paragraph_ascii"]) == ("pali", "pali", "Ete")


def test_first_alias_wins_and_order_is_given(spark):
    raw = spark.createDataFrame([("b", "1", "E", "T", "Z")],
                                "book_id string, para_id string, english_paragraph string, "
                                "translation_paragraph string, zh_paragraph string")
    row = build_corpus(raw, CorpusConfig(concat_order=["zh", "en"])).first()
    assert row["multilingual_concat"] == "Z \n T"


def test_fallback_concat_uses_other_strings_and_the_key(spark):
    raw = spark.createDataFrame([("b", "1", "text", None, 7)],
                                "book_id string, para_id string, body string, extra string, n int")
    assert build_corpus(raw).first()["multilingual_concat"] == "text \n  \n b:1"


def test_missing_id_column_is_named(spark):
    raw = spark.createDataFrame([("b", "x")], "book_id string, pali_text string")
    with pytest.raises(ValueError, match="para_id"):
        build_corpus(raw)


@pytest.mark.parametrize("ids", ["book_id", [1, 2], []])
def test_id_fields_must_be_names(ids):
    with pytest.raises(ValueError):
        CorpusConfig(id_fields=ids)


def test_dedup_keeps_first_line_and_survives_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("k"), F.col("id").alias("line"))
    rows = deduplicate(df, ["k"], ["line"])
    assert rows.count() == 2001
    assert rows.where("k = 'hot'").first()["line"] == 0


def test_nulls_are_equal_in_dedup(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, line int")
    assert sorted((r["k"] or "", r["line"]) for r in deduplicate(df, ["k"]).collect()) == [("", 1), ("a", 3)]


def test_csv_round_trip(spark, tmp_path):
    csv = tmp_path / "in.csv"
    csv.write_text('book_id,para_id,pali_paragraph,translation_paragraph\n'
                   'abh01a.att,442,"Tepajja pupphitā sabbe, dhuvaṃ","He said: ""I did not"" go\nforth"\n'
                   'abh01a.att,443,NA,\n', encoding="utf-8")
    out = str(tmp_path / "corpus")
    summary = ingest_csv(spark, str(csv), out).first()
    assert (summary["rows"], summary["parquet"]) == (2, out)
    assert summary["used_text_columns"] == ["pali_paragraph", "translation_paragraph"]
    assert summary["id_fields"] == ["book_id", "para_id"]
    rows = source.read_corpus(spark, out).orderBy("para_id").collect()
    assert rows[0]["translation_paragraph"] == 'He said: "I did not" go\nforth'
    assert (rows[1]["pali_paragraph"], rows[1]["translation_paragraph"]) == ("NA", None)
    marked = source.read_corpus_csv(spark, str(csv), na_values=source.COMMON_NA_VALUES)
    assert marked.where("para_id = '443'").first()["pali_paragraph"] is None


def test_single_line_csv_and_several_files(spark, tmp_path):
    for name, row in (("a.csv", "b,1,p"), ("b.csv", "b,2,q")):
        (tmp_path / name).write_text(f"book_id,para_id,pali_text\n{row}\n", encoding="utf-8")
    raw = source.read_corpus_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], multi_line=False)
    assert sorted(r["doc_id"] for r in build_corpus(raw).collect()) == ["b:1", "b:2"]


def test_missing_path_fails(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        source.read_corpus_csv(spark, "/tmp/no-such-file.csv").count()


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([("1", "x")], "id string, a string")
    b = spark.createDataFrame([("2", "y")], "id string, b string")
    assert sorted(tuple(r) for r in source.union_corpora([a, b]).fillna("-").collect()) == [
        ("1", "x", "-"), ("2", "-", "y")]


def test_deduplication_shuffles_digests_first(spark):
    from duoglot.operators.corpus import deduplicate
    rows = [(i, f"k{i % 50}" if i % 3 else None, "t" * (i % 4), i) for i in range(400)]
    df = spark.createDataFrame(rows, "n long, k string, t string, line long").repartition(7)
    want = {}
    for n, k, t, line in rows:
        want[k, t] = min(want.get((k, t), 10**9), line)
    got = deduplicate(df, ["k", "t"], ["line"])
    assert got.columns == df.columns
    assert {(r["k"], r["t"]): r["line"] for r in got.collect()} == want and got.count() == len(want)
    # Without a repeated key nothing is shuffled at all.
    single = deduplicate(df.dropDuplicates(["k", "t"]).select("n", "k", "t").checkpoint(), ["k", "t"])
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    assert deduplicate(df.limit(0), ["k", "t"]).count() == 0
