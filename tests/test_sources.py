import csv
import gzip
import random

import pytest

from tablestory.operators import jobs as J
from tablestory.sources import quoted_lines as Q, tables as S, text_tables as C


def put(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_quotes_breaks_and_padding(spark, tmp_path):
    df = C.read_csv(spark, put(tmp_path, '﻿label,"Height(Inches)",note\n"a, b",1,"two\nlines"\n\n"say ""hi""",2\n,,\n'))
    assert df.columns == ["label", "Height(Inches)", "note"]
    assert sorted(tuple(r) for r in df.collect()) == [("a, b", "1", "two\nlines"), ('say "hi"', "2", None)]


@pytest.mark.parametrize("text", [
    "", " \n\n", "a,b\n", "a,b\n,,\n \n", "<html><body>not csv</body></html>", "  <!DOCTYPE html>\n<p>1,2", "%PDF-1.7\n1,2", "a,b\n1,\0\n", b"a,b\n1,\xff\xfe\n", "a,A\n1,2", "a,,c\n1,2,3"])
def test_what_is_not_a_table(spark, tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    with pytest.raises(C.TableError):
        C.read_csv(spark, str(path))


def test_unclosed_quotes_end_with_the_file(spark, tmp_path):
    assert [tuple(r) for r in C.read_csv(spark, put(tmp_path, 'a,b\n1,2\n"unclosed,value')).collect()] == [("1", "2"), ("unclosed,value", None)]


def split(record, sep):
    """Fields of a record, a character at a time."""
    fields, now, inside, fresh, at = [], "", False, True, 0
    while at < len(record):
        c = record[at]
        if inside and c == '"' and record[at + 1:at + 2] == '"':
            now, at = now + c, at + 1
        elif inside and c == '"':
            inside = False
        elif not inside and fresh and c == '"':
            inside = True
        elif not inside and c == sep:
            fields, now, fresh, at = [*fields, now], "", True, at + 1
            continue
        else:
            now += c
        fresh, at = False, at + 1
    return [*fields, now], inside


@pytest.mark.parametrize("seed", range(3))
def test_open_quotes_match_a_plain_reader(seed):
    r = random.Random(seed)
    for _ in range(3000):
        line = "".join(r.choice('",;ab ""') for _ in range(r.randint(0, 12)))
        assert Q.ends_inside(line.encode(), False, b",") == split(line, ",")[1]
        assert Q.ends_inside(line.encode(), True, b",") == split('"' + line, ",")[1]


@pytest.mark.parametrize("block", [40, 97, 1000, 1 << 20])
def test_quoted_breaks_are_read_by_many_tasks(spark, tmp_path, block):
    r = random.Random(block)
    cells = ["plain", "x y", 'say "hi"', "two\nlines", "a, b", "many\n\n\nlines, \"q\"\n", "Été\n", "1", "stray\"s", "long " * 40 + "\nend"]
    rows = [[str(k), *(r.choice(cells) for _ in range(2))] for k in range(300)]
    for name, part in (("p1.csv", rows[:200]), ("p2.csv", rows[200:])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(["id", "the\nfirst", "second"])
            out.writerows(part)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        found = Q.blocks(spark, str(tmp_path), ",")
        assert found.count() > 100 or block > 97
        df = C.read_csv(spark, str(tmp_path), row_index="at")
        got = df.collect()
        multi = spark.read.csv(str(tmp_path), header=True, quote='"', escape='"', multiLine=True)
        assert df.rdd.getNumPartitions() > 50 or block > 97
        assert sorted(tuple(x)[:3] for x in got) == sorted(map(tuple, multi.collect())) == sorted(map(tuple, rows))
        for low, high in ((0, 200), (200, 300)):
            own = sorted((x.at, int(x.id)) for x in got if low <= int(x.id) < high)
            assert [k for _, k in own] == list(range(low, high))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("header, delimiter", [("a;b;c", ";"), ("a\tb", "\t"), ("a|b|c", "|"), ("a", ","), ('"x;y",b', ","), ("a,b;c", ",")])
def test_delimiters(spark, header, delimiter):
    assert C.sniff_delimiter(spark.createDataFrame([(header,)], "value string")).first().delimiter == delimiter


def test_headers():
    assert C.tidy_header([' "a" ', 'Height"', "b"]) == ["a", "Height", "b"]
    for bad in (["a", "A"], ["", "b"], ["x" * 201], []):
        with pytest.raises(C.TableError):
            C.tidy_header(bad)


def test_gzip_and_required_columns(spark, tmp_path):
    path = tmp_path / "t.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("a,b\n1,yes\n2,no\n")
    df = C.load_table(spark, str(path), required=["a"])
    assert dict(df.dtypes) == {"a": "double", "b": "boolean"}
    with pytest.raises(C.TableError):
        C.read_csv(spark, str(path), required=["z"])


def test_types_and_bounds(spark):
    df = spark.createDataFrame([("1", "yes", "", "1", "x"), (" 2.5e1 ", "FALSE", None, "true", "1")], "n string, b string, e string, mix string, s string")
    assert {r["column"]: r.type for r in C.infer_types(df).collect()} == {"n": "number", "b": "boolean", "e": "empty", "mix": "string", "s": "string"}
    assert [(r.rule, r.found) for r in C.check_bounds(df, max_rows=1, max_columns=4, max_cell=3).orderBy("rule").collect()] == [
        ("cell", 7), ("columns", 5), ("rows", 2)]


def test_formulas_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(-1.0, "=x", True), (2.0, 'a "b", c', None)], "v double, s string, f boolean")
    C.write_csv(df, str(tmp_path / "plain"))
    assert sorted(map(tuple, C.load_table(spark, str(tmp_path / "plain"), sep=",").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    C.write_csv(df, str(tmp_path / "safe"), safe=True)
    assert {r.v for r in C.read_csv(spark, str(tmp_path / "safe"), sep=",").collect()} == {"'-1", "2"}


def test_stored_tables_replace_one_dataset(spark, tmp_path):
    path = str(tmp_path / "tables")
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    S.write_table(make(3, 1, 2), path, "a", ["v"])
    S.write_table(make(9), path, "b", ["v"])
    S.write_table(make(5, 4), path, "a", ["v"])
    assert [(r.row_index, r.v) for r in S.read_table(spark, path, "a").collect()] == [(0, 4), (1, 5)]
    assert [r.v for r in S.read_table(spark, path, "b").collect()] == [9]


def test_hash_ignores_row_order_but_not_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    h = lambda d: S.content_hash(d).first().content_hash
    assert h(df) == h(df.orderBy("i", ascending=False).repartition(3))
    assert h(df) != h(df.unionByName(df)) and h(df) != h(df.limit(1))


def test_job_guards(spark):
    df = spark.createDataFrame([(1, 2, "x")], "a int, result int, lat string")
    with pytest.raises(ValueError):
        J.project_allowed(df, ["a", "result"], {"result"})
    assert J.coords_of(df).first().latitude is None


@pytest.mark.parametrize("change, broken", [
    ("play + 0", set()), ("CASE WHEN play = 3 THEN 2 ELSE play END", {"unique"}), ("CASE WHEN play = 3 THEN NULL ELSE play END", {"known", "count"}),
])
def test_constraints_catch_changes(spark, change, broken):
    from pyspark.sql import functions as F

    df = spark.range(1, 6).select(F.col("id").alias("play")).selectExpr(f"CAST({change} AS INT) AS play", "2 AS qtr")
    report = J.constraint_report(df, {"known": F.col("play").isNotNull(), "quarter": F.col("qtr").between(1, 4)}, {"count": (F.col("play").isNotNull(), 5)})
    found = {r.rule for r in report.where("not ok").collect()}
    if df.where("play is not null").groupBy("play").count().where("count > 1").count():
        found.add("unique")
    assert found == broken


def test_content_hash_follows_appended_rows_alone(spark, tmp_path):
    path = str(tmp_path / "tables")
    rows = [(k, f"v{k % 3}", None if k % 4 == 0 else k / 2) for k in range(50)]
    make = lambda part: spark.createDataFrame(part, "k int, s string, d double")
    whole = S.content_hash(make(rows)).first()
    S.append_rows(make(rows[:20]), path, "a", ["k"])
    S.append_rows(make(rows[20:21]), path, "a", ["k"])
    S.append_rows(make([]), path, "a", ["k"])
    S.write_table(make(rows[:5]), path, "b", ["k"])
    S.append_rows(make(rows[21:]), path, "a", ["k"])
    assert S.stored_hash(spark, path, "a").first() == whole and S.read_table(spark, path, "a").count() == 50
    assert S.stored_hash(spark, path, "b").first() == S.content_hash(make(rows[:5])).first()
    S.write_table(make([]), path, "b", ["k"])
    assert S.stored_hash(spark, path, "b").first() == S.content_hash(make([])).first()
    changed = S.content_hash(make([(0, "v0", 1.0), *rows[1:]])).first()
    assert changed.rows == 50 and changed.content_hash != whole.content_hash
    # Sums that a failed write left behind are made anew.
    S._keep_sums(S.hash_sums(make(rows[:3])), path, "a")
    assert S.stored_hash(spark, path, "a").first() == whole
