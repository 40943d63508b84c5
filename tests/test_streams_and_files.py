import csv
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxfare import session
from voxfare.sources import files, schemas
from voxfare.streaming import incremental


def test_na_tokens_keep_lower_case_none(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a,b\n"x, ""q""\nline",N/A\nnone,null\n,None\nNaN,ok\n', encoding="utf-8")
    got = [tuple(r) for r in files.read_reviews(spark, str(path), schemas.csv_schema(["a", "b"])).collect()]
    assert got == [('x, "q"\nline', None), ("none", None), (None, None), (None, "ok")]


@pytest.mark.parametrize("split", ["7b", "64b", "1k", "128m"])
def test_csv_in_splits(spark, tmp_path, split):
    """Line breaks inside quotes, at every place against the splits, as Python's csv module writes them."""
    rng = random.Random(len(split))
    cells = ["x", "", "a b", 'say "hi"', "two\nlines", "three\n\nlines", "\r\n", ",", "éü", "long " * 12, '"', '"\n"']
    (tmp_path / "in").mkdir()
    want = []
    for name in "abc":
        rows = [[rng.choice(cells) for _ in range(3)] for _ in range(30)]
        want += rows
        with open(tmp_path / "in" / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            writer = csv.writer(f, lineterminator="\r\n" if name == "b" else "\n")
            writer.writerows([["p", "q", "r"], *rows])
    (tmp_path / "in" / "d.csv").write_text('p,q,r\n\n1,2,3\n\n4,5,"no\nend', encoding="utf-8")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        parts = spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions()
        assert parts > 40 if split == "64b" else parts >= 1
        got = [tuple(r) for r in files.read_reviews(spark, str(tmp_path / "in"), schemas.csv_schema(["p", "q", "r"]), tokens=("",)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    filled = [tuple(c or None for c in r) for r in want]
    assert Counter(got) == Counter([*filled, ("1", "2", "3"), ("4", "5", "no\nend")])


def test_csv_with_mark(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("é", ["a", None, "b"], 1)], "name string, tags array<string>, n int").coalesce(1)
    files.write_csv(df, out, bom=True)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfname,tags,n\n") and "é,a | b,1" in part.read_text("utf-8")
    back = files.read_reviews(spark, out, schemas.csv_schema(["name", "tags", "n"]))
    assert [tuple(r) for r in back.collect()] == [("é", "a | b", "1")]


def test_records(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text('[{"a": 1, "b": {"c": "x"}}, {"a": 2}]')
    got = files.read_records(spark, str(path), spark.createDataFrame([], "a int, b struct<c string>").schema, multi_line=True)
    assert [(r["a"], r["b"].c if r["b"] else None) for r in got.collect()] == [(1, "x"), (2, None)]


def test_union_and_projection(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert [tuple(r) for r in files.union_sources(a, b).orderBy("i").collect()] == [(1, "x"), (2, None)]
    assert files.project(b, ["i", "z"]).columns == ["i", "z"]


def test_stages(spark, tmp_path):
    df = spark.createDataFrame([(2020, "a"), (2021, "b")], "year int, v string")
    files.write_stage(df, str(tmp_path / "s"), ["year"])
    back = files.read_stage(spark, str(tmp_path / "s")).filter("year = 2021")
    assert [r["v"] for r in back.collect()] == ["b"]
    assert session.checkpointed(df).count() == 2


def test_spread_and_compact(spark, tmp_path):
    df = spark.range(1000).coalesce(1)
    df.write.parquet(str(tmp_path / "p"))
    scan = spark.read.parquet(str(tmp_path / "p"))
    assert files.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, 1, 8)
    held = files.compact(wide, 500)
    assert held.rdd.getNumPartitions() == 2 and held.count() == 1000
    held.unpersist()


def test_cluster_without_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        session.shared_dir(Fake(), "x")


def reply(batch):
    return batch.withColumn("reply", F.when(F.col("t") == "bad", "oops").otherwise(F.to_json(F.struct(F.col("t").alias("top_praise")))))


def test_extraction_resumes(spark, tmp_path):
    src, good, bad, cp = (str(tmp_path / d) for d in ("src", "good", "bad", "cp"))
    schema = "review_id int, t string"

    def run():
        source = spark.readStream.schema(schema).json(src)
        incremental.extract_stream(source, reply, "review_id", good, bad, cp).awaitTermination()

    spark.createDataFrame([(1, "a"), (2, "bad")], schema).coalesce(1).write.mode("append").json(src)
    run()
    run()
    spark.createDataFrame([(3, "c")], schema).coalesce(1).write.mode("append").json(src)
    run()
    assert sorted((r["review_id"], r["top_praise"]) for r in spark.read.parquet(good).collect()) == [(1, "a"), (3, "c")]
    assert [(r["review_id"], r["raw"]) for r in spark.read.parquet(bad).collect()] == [(2, "oops")]


def test_batch_twin(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "review_id int, t string")
    done = spark.createDataFrame([(1,)], "review_id int")
    good, bad = incremental.extract_batch(df, done, "review_id", reply)
    assert [r["review_id"] for r in good.collect()] == [3] and [r["review_id"] for r in bad.collect()] == [2]


def test_each_row_has_one_reply(spark):
    """A reply that differs from call to call: no row is lost and none comes out twice."""

    def unsteady(df):
        text = F.when(F.rand() < 0.5, F.lit("oops")).otherwise(F.lit('{"top_praise": "x"}'))
        return df.withColumn("reply", text)

    df = spark.range(400).withColumnRenamed("id", "review_id")
    good, bad = incremental.extract_batch(df, df.limit(0), "review_id", unsteady)
    assert sorted([r["review_id"] for r in good.collect()] + [r["review_id"] for r in bad.collect()]) == list(range(400))


def test_daily_summary_drops_repeats_and_marks_open_days(spark, tmp_path):
    src, out, cp = (str(tmp_path / d) for d in ("ev", "days", "cp"))
    t0 = datetime(2024, 1, 1, 12)
    rows = [(i, t0 + timedelta(days=i // 2), "a", 1.0 + i) for i in range(14)]
    schema = "id int, ts timestamp_ntz, kind string, v double"

    def run(batch):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = incremental.daily_summary(spark.readStream.schema(schema).parquet(src), "ts", "id", "kind", "v")
        incremental.run_to_table(stream, out, cp).awaitTermination()
        days = incremental.complete_days(spark, out, cp, "kind")
        return days, {r["day_start"].day: (r["n"], r["total"], r["closed"]) for r in days.collect()}

    days, got = run(rows + rows[:4])
    full = {d + 1: (2, 2.0 * (2 * d) + 3.0) for d in range(7)}
    assert got == {d: (*x, d <= 4) for d, x in full.items()}  # last event day 7 minus two days closes days 1 to 4
    month = incremental.roll_up_months(days, "kind").first()
    assert (month["n"], month["total"], month["open_days"]) == (14, sum(1.0 + i for i in range(14)), 3)
    late = [(20, t0 + timedelta(days=5), "a", 100.0), (21, t0 + timedelta(days=9), "a", 7.0), (13, t0 + timedelta(days=6), "a", 14.0)]
    _, again = run(late)  # one late row, one new day that closes three more, one repeat
    want = {d: (*x, True) for d, x in full.items()} | {6: (3, full[6][1] + 100.0, True), 10: (1, 7.0, False)}
    assert again == want


def test_compact_gives_each_core_a_part_once_there_are_rows_enough(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(100 * cores, numPartitions=2 * cores)
    assert files.compact(wide.select("id"), least=50).rdd.getNumPartitions() == cores
    assert files.compact(wide.selectExpr("id + 1 AS id"), least=99).rdd.getNumPartitions() == cores
    assert files.compact(wide.selectExpr("id + 2 AS id")).rdd.getNumPartitions() == 1
