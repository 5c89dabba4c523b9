"""Ids that repeat or are no numbers, columns of any type, texts beyond a sample's bound."""

import duckdb
import pytest
from pyspark.sql import functions as F

from orbitspark.llm import decontaminate, quality, sharding, sql, suffix


def test_suffix_on_repeated_ids_is_its_sql(spark):
    text = "the quick brown fox jumps over the lazy dog and then it runs away from all of us for good, or so they say"
    rows = [(3, text), (3, text), (3, "x" + text), (1, "a short one"), (5, text[10:90]), (5, text), (7, None), (2, text[:60]), (7, text + text)]
    got = suffix.remove_seen(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    # the SQL tells documents by their id alone, so rows of one id are told apart there by hand
    want = []
    for i, (key, t) in enumerate(rows):
        one = duckdb.connect()
        one.execute("create table documents(doc_id bigint, text varchar)")
        one.executemany("insert into documents values (?, ?)", [(k, x) for j, (k, x) in enumerate(rows) if k != key or j == i])
        distinct = {}
        for k, x in one.execute("select * from documents").fetchall():
            distinct.setdefault(k, []).append(x or "")
        one.execute("delete from documents")
        one.executemany("insert into documents values (?, ?)", [(k, "".join(x) if len(x) == 1 else "\x00".join(x)) for k, x in distinct.items()])
        want.append(next(tuple(r) for r in one.execute(sql.OP10).fetchall() if r[0] == key))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rows_of_one_id_take_nothing_from_each_other(spark):
    same = "some text of more than fifty bytes that two rows with one id hold, byte for byte"
    got = suffix.remove_seen(spark.createDataFrame([(3, same), (3, same), (None, same), (None, same)], "doc_id long, text string"))
    assert [r["n_removed"] for r in got.where("doc_id = 3").collect()] == [0, 0]
    assert [r["n_removed"] for r in got.where("doc_id is null").collect()] == [len(same)] * 2  # null ids come after
    many = spark.range(300).select((F.col("id") % 3).alias("doc_id"), F.lit(same).alias("text")).repartition(7)
    assert {(r["doc_id"], r["n_removed"]) for r in suffix.remove_seen(many).collect()} == {(0, 0), (1, len(same)), (2, len(same))}


@pytest.mark.parametrize("kind", ["string", "decimal(20,3)", "date", "int"])
def test_benchmark_ids_of_any_type(spark, kind):
    text = "seven little words that make one item here"
    ids = {"string": "q-1", "decimal(20,3)": "1.5", "date": "2024-01-02", "int": "4"}
    bench = spark.createDataFrame([(ids[kind], text), (None, "another item of many words")], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "another item of many words"), (3, None)], "doc_id long, text string")
    found = decontaminate.contaminated(docs, bench)
    assert found.select("doc_id", F.col("item_id").cast("string")).collect() == [(1, bench.where("item_id is not null").select(F.col("item_id").cast("string")).first()[0])]
    assert dict(found.dtypes)["item_id"] == ("bigint" if kind == "int" else kind)
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {2, 3}


def test_shards_of_records_with_maps(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("m"), F.lit(9).alias("slot"), F.lit(None).cast("map<string,int>").alias("none"))
    got = sharding.assign_shards(df, ["doc_id"], 4)
    assert dict(got.dtypes)["m"] == "map<string,bigint>"
    assert sorted((r["doc_id"], r["m"]["k"], r["none"]) for r in got.collect()) == [(i, i, None) for i in range(40)]
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [10] * 4


def test_one_long_text_does_not_empty_the_fit(spark):
    docs = spark.range(120).select("id", F.when(F.col("id") % 2 == 0, "plain words in a row, as ever.").otherwise("@@ ## $$ %% ^^ && **").alias("t"))
    # the first document by hash is longer than all that may be learnt from
    first = docs.where(~quality.held_out("id")).orderBy(F.xxhash64("id"), "id").first()["id"]
    docs = docs.select(F.col("id").alias("doc_id"), F.when(F.col("id") == first, F.repeat(F.lit("long "), 40_000)).otherwise(F.col("t")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    model = quality.fit(docs, labels, size=100_000)
    got = quality.score(docs.where(F.col("doc_id") != first), model, ["doc_id"])
    assert got.where((F.col("score") >= 0.5) == (F.col("doc_id") % 2 == 0)).count() == 119
    assert quality.score(docs.where("false"), model, ["doc_id"]).count() == 0
