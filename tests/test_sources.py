"""CSV parts: header rows anywhere, ragged rows, quoting, per-file heads."""

import tempfile

from netvigil.sources import csv_parts, lookups

NAMES = ["a", "b", "attack"]


def _write(d, name, text):
    with open(f"{d}/{name}", "w") as fh:
        fh.write(text)


def test_read_parts_rules(spark):
    d = tempfile.mkdtemp(prefix="netvigil-csv-")
    _write(d, "data_names.csv", " a , b,attack \n")
    _write(d, "data_1.csv", "A, b ,ATTACK\n1,2,normal\n3,\"x,y\",attack\n")
    _write(d, "data_2.csv", "4,5,1\n6\n7,8,1,extra\na,b,attack\n")
    _write(d, "data_3.csv", "9,9,0\n")
    _write(d, "other.csv", "should,not,read\n")
    names = csv_parts.load_columns(spark, f"{d}/data_names.csv")
    assert names == NAMES
    df = csv_parts.read_parts(spark, d, names)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == sorted([("1", "2", "normal"), ("3", "x,y", "attack"), ("4", "5", "1"),
                           ("6", None, None), ("9", "9", "0")])
    two = csv_parts.read_parts(spark, d, names, max_files=2)
    assert two.count() == 4
    skipped = csv_parts.read_parts(spark, d, names, skip_files=2)
    assert [tuple(r) for r in skipped.collect()] == [("9", "9", "0")]
    assert csv_parts.list_parts(spark, d)[0].endswith("data_1.csv")


def test_head_per_file(spark):
    d = tempfile.mkdtemp(prefix="netvigil-csv-")
    _write(d, "data_1.csv", "".join(f"{i},x,0\n" for i in range(50)))
    _write(d, "data_2.csv", "".join(f"{100 + i},y,1\n" for i in range(5)))
    df = csv_parts.read_parts(spark, d, NAMES)
    heads = sorted(int(r[0]) for r in csv_parts.head_per_file(df, 3).collect())
    assert heads == [0, 1, 2, 100, 101, 102]


def test_csv_with_own_header_and_device_map(spark):
    d = tempfile.mkdtemp(prefix="netvigil-csv-")
    _write(d, "up.csv", "x,y\n1,2\n")
    assert csv_parts.read_csv_with_header(spark, f"{d}/up.csv").columns == ["x", "y"]
    _write(d, "devices.csv", "ip,name,type\n10.0.0.1,cam,camera\n,blank,x\n10.0.0.1,cam2, \n")
    got = {r["device"]: (r["name"], r["dtype"]) for r in lookups.device_table_csv(spark, f"{d}/devices.csv").collect()}
    assert got == {"10.0.0.1": ("cam2", None)}


def test_union_labelled_and_hash_shuffle(spark):
    from netvigil.operators.combine import hash_shuffled, union_labelled

    a = spark.createDataFrame([(1, "attack")], "x int, attack string")
    b = spark.createDataFrame([(2, "normal", 7)], "x int, label string, extra int")
    c = spark.createDataFrame([(3,)], "x int")
    u = union_labelled([a, b, c])
    rows = sorted((r["x"], r["label_raw"], r["extra"]) for r in u.collect())
    assert rows == [(1, "attack", None), (2, "normal", 7)]
    df = spark.range(50).withColumnRenamed("id", "k")
    first = [r[0] for r in hash_shuffled(df, ["k"]).collect()]
    again = [r[0] for r in hash_shuffled(df.repartition(5), ["k"]).collect()]
    assert first == again and sorted(first) == list(range(50)) and first != list(range(50))
