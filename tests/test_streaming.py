from pyspark.sql.types import StringType, StructField, StructType

from duoglot.operators.corpus import build_corpus
from duoglot.plans.index import build_index
from duoglot.sources.index_tables import open_index
from duoglot.streaming.upsert import stream_csv, stream_upsert

COLUMNS = ["book_id", "para_id", "pali_paragraph", "translation_paragraph"]


def test_csv_stream_upserts_each_file_once(spark, tmp_path):
    incoming, path, state = tmp_path / "in", str(tmp_path / "i"), str(tmp_path / "state")
    incoming.mkdir()
    seed = spark.createDataFrame([("b", "1", "old", "old"), ("b", "9", "kept", None)],
                                 "book_id string, para_id string, pali_paragraph string, translation_paragraph string")
    build_index(spark, build_corpus(seed), path)

    def put(name, *rows):
        (incoming / name).write_text("\n".join([",".join(COLUMNS), *rows]) + "\n", encoding="utf-8")

    def run():
        stream = stream_csv(spark, str(incoming), StructType([StructField(c, StringType()) for c in COLUMNS]))
        stream_upsert(stream, path, state).awaitTermination()

    put("1.csv", "b,1,new,new", "b,2,two,two")
    run()
    put("2.csv", "b,2,zwei,\"two, \"\"again\"\"\"", "b,3,three,")
    run()
    run()
    index = open_index(spark, path)
    rows = {r["doc_id"]: (r["pali_paragraph"], r["translation_paragraph"]) for r in index.docs().collect()}
    assert rows == {"b:1": ("new", "new"), "b:2": ("zwei", 'two, "again"'), "b:3": ("three", None), "b:9": ("kept", None)}
    assert len(index.generations) == 3
