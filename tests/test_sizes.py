"""Work whose tasks follow the input: sized shuffles, counted ranges, ends looked up once."""

from pyspark.sql import functions as F

from skein.functions import shared
from skein.operators import delta, history, index, merkle, search


def test_tasks_follow_stored_bytes(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"file:{tmp_path}/t")
    t = spark.read.parquet(f"file:{tmp_path}/t")
    assert shared.by_size(t, "id") is t and shared.stored_bytes(t) > 1000
    monkeypatch.setattr(shared, "TASK_BYTES", 200)
    assert shared.by_size(t, "id")._jdf.rdd().getNumPartitions() > 4


def test_hubs_hash_as_others_do(spark, monkeypatch):
    e = spark.createDataFrame([(str(i), f"h{i}") for i in range(9)] + [(None, "hn")], "id string, hash string")
    r = spark.createDataFrame([("calls", str(i % 3), str(i)) for i in range(9)] + [("calls", "0", "ghost"), ("calls", None, "1"), ("uses", "5", "0")], "kind string, src string, dst string")
    plain = sorted(map(tuple, merkle.subgraph_hashes(e, r, 2).collect()), key=str)
    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    assert plain == sorted(map(tuple, merkle.subgraph_hashes(e, r, 2).collect()), key=str) and len(plain) == 10


def test_first_rows_by_counted_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(i % 50,) for i in range(100)] + [(None,)] * 3, "id int")
    want = {n: df.orderBy("id").limit(n).collect() for n in (2, 3, 10, 60, 103, 200)}
    monkeypatch.setattr(index, "ORDERED_ROWS", 1)
    for n, rows in want.items():
        assert sorted(index.first_rows(df, n).collect(), key=str) == sorted(rows, key=str)


def test_absent_ends_and_what_they_take(spark):
    e = spark.createDataFrame([("a",), ("b",)], "id string")
    r = spark.createDataFrame([(1, "a", "b"), (2, "a", "x"), (3, "x", "y"), (4, None, "a"), (5, "b", None)], "id int, src string, dst string")
    assert sorted(x[0] for x in delta.absent_ends(e, r).collect()) == ["x", "y"]
    assert sorted(map(tuple, history.dangling(r, e).collect())) == [(2, "dst"), (3, "dst"), (3, "src"), (4, "src"), (5, "dst")]
    kept, _, stats = delta.compact(e, r, {})
    assert [x.id for x in kept.collect()] == [1] and {x.what: x.removed for x in stats.collect()} == {"relations": 4, "outgoing": 3, "incoming": 4}


def test_text_frequencies_are_those_of_postings(spark):
    d = spark.createDataFrame([(1, "red red blue"), (2, "blueFish"), (3, None)], "id int, text string")
    post = search.postings(d.select("id", F.array(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit(1.0).alias("weight"))).alias("fields")))
    asked = ["blue", "red blue", "red nowhere", ""]
    assert search.text_frequencies(d, asked) == [search.doc_frequency(post, q) for q in asked] == [2, 1, 0, 0]
