"""CSV scans: quoted text read by several tasks, folders with mixed headers."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtrust.sources import csv_scan, io as cio

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("x", T.DoubleType())])


def quoted(s):
    return '"' + s.replace('"', '""') + '"'


def random_file(r, n, long=0):
    pieces = ["word", " ", "\n", "\n\n", '"', '""', ",", "é", "\r\n", "x" * 40, "\t", "'", "\\"]
    lines = ["k,a,b,x"]
    for i in range(n):
        a, b = ("".join(r.choices(pieces, k=r.randint(0, 12))) for _ in range(2))
        if long and i == n // 2:
            a = ('long "text"\n' * long)
        b = quoted(b) if r.random() < 0.7 else r.choice(["plain", "", "two words"])
        lines.append(f"{i},{quoted(a)},{b},{i / 4}")
    return "\n".join(lines) + r.choice(["", "\n", "\n\n"])


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "10", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def multi_line(spark, path):
    return spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_records_over_byte_ranges(spark, tmp_path, small_ranges, seed):
    """Ranges of 700 bytes: records end in other ranges than they begin in, a long one goes through many."""
    r = random.Random(seed)
    for f in range(2):
        with open(tmp_path / f"part {f}.csv", "w", newline="", encoding="utf-8") as out:
            out.write(random_file(r, 60, long=300 if seed % 2 else 0))
    path = f"file://{tmp_path}"
    own = csv_scan.read_quoted_csv(spark, path, SCHEMA)
    assert csv_scan.text_lines(spark, path).rdd.getNumPartitions() > 10
    assert rows(own) == rows(multi_line(spark, path))
    assert own.count() == 120


def test_quoted_records_of_odd_files(spark, tmp_path, small_ranges):
    files = {"empty": "", "header": "k,a,b,x\n", "one": 'k,a,b,x\n1,"a\nb",c,2.5', "crlf": 'k,a,b,x\r\n1,"a\r\nb",c,2.5\r\n2,d,"",\r\n', "long header": '"k",\"a\",b,x\n7,"",,'}
    for name, text in files.items():
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as out:
            out.write(text)
    path = f"file://{tmp_path}"
    assert rows(csv_scan.read_quoted_csv(spark, path, SCHEMA)) == rows(multi_line(spark, path)) and csv_scan.read_quoted_csv(spark, path, SCHEMA).count() == 4


def test_a_large_quoted_file_is_read_by_several_tasks(spark, tmp_path):
    r = random.Random(9)
    with open(tmp_path / "big.csv", "w", newline="", encoding="utf-8") as out:
        out.write("prompt_id,text_a,text_b,truth_is_a\n")
        for i in range(60_000):
            out.write(f'{i},{quoted("line one" + chr(10) + "say ""hi"", " + "z" * r.randint(0, 600))},{quoted(chr(10) * (i % 3) + "b")},{i % 2}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        path = f"file://{tmp_path}/big.csv"
        assert os.path.getsize(tmp_path / "big.csv") > 15 << 20
        got = cio.read_prompts_csv(spark, path)
        kept = got.select(F.count("*"), F.sum(F.xxhash64("prompt_id", "text_a", "text_b", "truth_is_a").cast("decimal(38,0)")))
        one = spark.read.schema(cio.PROMPTS_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        assert one.rdd.getNumPartitions() == 1 and csv_scan.text_lines(spark, path).rdd.getNumPartitions() > 7
        assert kept.first() == one.select(F.count("*"), F.sum(F.xxhash64("prompt_id", "text_a", "text_b", "truth_is_a").cast("decimal(38,0)"))).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return f"file://{folder}"


def test_metric_files_with_other_headers(spark, tmp_path):
    path = put(tmp_path, a_metrics="epoch,train_loss,test_accuracy\n1,3.0,0.5\n2,2.0,0.6\n", b_metrics="train_loss,epoch,test_accuracy\n3,1,0.9\n",
               **{"a0_metrics": "step,train_loss\n1,9\n", "c d+e%_metrics": '"epoch","train_loss","note"\n1,4,"x, y"\n,5,\n', "empty_metrics": "", "only_metrics": "epoch,train_loss\n"})
    got = rows(cio.scan_metric_files(spark, f"{path}/*_metrics.csv"))
    assert got == rows(spark.createDataFrame([("a", 1, 3.0, 0.5), ("a", 2, 2.0, 0.6), ("b", 1, 3.0, 0.9), ("c d+e%", 1, 4.0, None)],
                                             "run string, epoch int, train_loss double, test_accuracy double"))
    assert cio.scan_metric_files(spark, f"{path}/a0_metrics.csv").count() == 0


def test_frames_with_other_headers(spark, tmp_path):
    path = put(tmp_path, iter_10="annotator_id,inferred_acc\n1,0.5\n", iter_9="inferred_acc,annotator_id\n0.25,7\n0.75,1\n", iter_2="x,annotator_id,inferred_acc\n8,1,0.125\n")
    got = [tuple(r)[:3] for r in cio.scan_frames_natural(spark, path, "iter_*.csv").collect()]
    assert got == [(1, 0.125, 2), (1, 0.75, 9), (7, 0.25, 9), (1, 0.5, 10)]


def test_a_spine_far_larger_than_its_ids_is_refused(spark):
    far = spark.createDataFrame([(1, 0.5), (10 ** 12, 0.7)], "prompt_id long, g double")
    with pytest.raises(ValueError):
        cio.dense_ids(far, "prompt_id", {"g": 0.5})
    assert cio.dense_ids(far, "prompt_id", {"g": 0.5}, max_id=3).count() == 4
