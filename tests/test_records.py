"""CSV records with line breaks inside values, over many splits of one file."""

import csv
import io
import random

import pytest

from orderlens.sources.csv import read_role
from orderlens.sources.records import csv_records

HEADER = ["review_id", "order_id", "review_score", "review_comment_message"]
SPLIT_CONF = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def small_splits(spark):
    for key in SPLIT_CONF:
        spark.conf.set(key, "900b")
    yield
    for key in SPLIT_CONF:
        spark.conf.unset(key)


def review_file(folder, name="a_order_reviews_dataset.csv", seed=1, n=150, end="\n", **tricks):
    """Reviews whose texts hold quotes, separators and line breaks; one text is longer than several splits."""
    rng = random.Random(seed)
    parts = ["good", 'a "quoted" word', "x,y", "\n", "\n\n", '"', '""', "long text " * 9, "é中", ""]
    rows = [[f"r{k}", f"o{k}", str(k % 5 + 1), "".join(rng.choices(parts, k=rng.randint(0, 6)))] for k in range(n)]
    if n:
        rows[n // 2][3] = 'first "line"\nnext, line\n' * 300
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerows([HEADER, *rows])
    (folder / name).write_bytes(out.getvalue().encode())
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_file_gives_the_rows_of_the_one_task_reader(spark, tmp_path, small_splits, end):
    rows = review_file(tmp_path, end=end)
    path = str(tmp_path / "a_order_reviews_dataset.csv")
    lines = spark.read.text(path)
    assert lines.rdd.getNumPartitions() > 15
    records = csv_records(spark, [path])
    numbered = {r["_number"]: r["record"] for r in records.collect()}
    assert sorted(numbered) == list(range(1, len(rows) + 2))
    for number, text in numbered.items():
        assert next(csv.reader(io.StringIO(text, newline=""))) == [HEADER, *rows][number - 1]
    got = sorted(map(tuple, read_role(spark, str(tmp_path), "order_reviews").collect()))
    one_task = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).selectExpr("order_id", "int(review_score)")
    assert got == sorted(map(tuple, one_task.collect())) == sorted((r[1], int(r[2])) for r in rows)


def test_files_with_other_headers_empty_lines_and_no_rows(spark, tmp_path, small_splits):
    first = review_file(tmp_path, n=50, seed=2)
    review_file(tmp_path, "b_order_reviews_dataset.csv", n=0)
    (tmp_path / "c_order_reviews_dataset.csv").write_text('review_score,"order\nnote",order_id\n\n3,"a\n\nb",p1\n\n,,p2')
    got = sorted((r["order_id"], r["review_score"]) for r in read_role(spark, str(tmp_path), "order_reviews").collect())
    assert got == sorted([(r[1], int(r[2])) for r in first] + [("p1", 3), ("p2", None)])


def test_open_quotes_and_bad_values_stop_the_read(spark, tmp_path, small_splits):
    path = tmp_path / "a_order_reviews_dataset.csv"
    path.write_text('order_id,review_score,t\no1,5,"never closed\no2,4,x\n')
    with pytest.raises(Exception, match="left open"):
        read_role(spark, str(tmp_path), "order_reviews").collect()
    path.write_text("order_id,review_score,t\no1,five,x\n")
    with pytest.raises(Exception):
        read_role(spark, str(tmp_path), "order_reviews").collect()


def test_text_is_shuffled_once_by_split(spark, tmp_path, small_splits):
    review_file(tmp_path)
    df = read_role(spark, str(tmp_path), "order_reviews")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BatchEvalPython" not in plan and "SinglePartition" not in plan
    assert "ReusedExchange" in plan
