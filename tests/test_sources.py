"""CSV / ARFF scans on the reference's odd-file shapes (regenerated here, not copied)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kiln.sources import files


def _write(text: str, name: str = "f.csv") -> str:
    d = tempfile.mkdtemp(prefix="kiln-test-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


def test_scan_types_and_na_tokens(spark):
    p = _write("feature1,feature2,feature3,target\n1.5,2,A,0\nNA,3,B,1\n2.5,,C,0\n")
    df = files.scan_csv(spark, p)
    assert dict(df.dtypes) == {"feature1": "double", "feature2": "bigint", "feature3": "string", "target": "bigint"}
    assert df.filter("feature1 is null").count() == 1 and df.filter("feature2 is null").count() == 1


def test_header_only_bom_and_duplicates(spark):
    p = _write("﻿a,b,a\n")
    assert files.columns_of(spark, p) == ["a", "b", "a.1"]
    assert files.scan_csv(spark, p).count() == 0


def test_ragged_semicolon_unicode(spark):
    p = _write("x,y,z\n1,2\n3,4,5\n")
    df = files.scan_csv(spark, p)
    assert df.count() == 2 and df.filter("z is null").count() == 1
    p = _write("año;peso\n1;2.5\n")
    df = files.scan_csv(spark, p, sep=";")
    assert df.columns == ["año", "peso"] and df.first().peso == 2.5


def test_big_file_and_take_bytes(spark):
    rows = "\n".join(f"{i},{i * 2}" for i in range(1500))
    df = files.scan_csv(spark, _write("a,b\n" + rows + "\n"))
    assert df.count() == 1500
    cut = files.take_bytes(df, ["a"], 100)
    # rows 0..9 take 4 bytes ("i,2i\\n"), 10..49 take 6 or 7 bytes
    total = 0
    want = 0
    for i in range(1500):
        total += len(f"{i},{i * 2}") + 1
        if total > 100:
            break
        want += 1
    assert cut.count() == want


def test_arff_round_trip(spark):
    p = _write("% comment\n@relation t\n@attribute age numeric\n@attribute 'class' {N,P}\n@data\n39,N\n?,P\n",
               "t.arff")
    df = files.scan_arff(spark, p)
    assert df.columns == ["age", "class"]
    assert sorted((r["class"], r.age) for r in df.collect()) == [("N", 39.0), ("P", None)]


def test_positional_and_preview(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, b int, c int, d int, e int")
    assert files.first_n_plus_last(df, 2).columns == ["a", "b", "e"]
    assert files.preview(df, 1, ["a"]).count() == 1


def test_write_table_refuses_same_path(spark):
    with pytest.raises(ValueError):
        files.write_table(spark.range(1), "/tmp/x", source_path="/tmp/x/")


def test_csv_doubled_quotes_and_line_feeds(spark):
    p = _write('a,b\n1,"he said ""hi"", ok"\n2,"x\ny"\n')
    got = {r.a: r.b for r in files.scan_csv(spark, p, multiline=True).collect()}
    assert got == {1: 'he said "hi", ok', 2: "x\ny"}
    p = _write('a,b\n1,"he said ""hi"", ok"\n')
    assert files.scan_csv(spark, p).first().b == 'he said "hi", ok'


def test_arff_odd_data_lines_and_several_files(spark):
    import os
    import tempfile

    d = tempfile.mkdtemp(prefix="kiln-test-")
    texts = {"a.arff": "% c\n@RELATION t\n@ATTRIBUTE name string\n@ATTRIBUTE n numeric\n@DATA\n@home,1\n%x,2\n'a,b',4\n\"q\"\"\n'it\\'s',?\n",
             "b.arff": "@relation t\n@attribute n numeric\n@attribute 'other one' {u,v}\n@data\n@attribute,v\n7,u\n"}
    for name, text in texts.items():
        with open(os.path.join(d, name), "w") as fh:
            fh.write(text)
    df = files.scan_arff(spark, d)
    assert set(df.columns) == {"name", "n", "other one"}
    got = {(r.name, r.n, r["other one"]) for r in df.collect()}
    assert {("@home", 1.0, None), ("%x", 2.0, None), ("a,b", 4.0, None), ("it's", None, None), (None, None, "v"), (None, 7.0, "u")} <= got
    assert len(got) == 7


def test_arff_any_text_comes_back(spark, tmp_path):
    texts = ["", " a ", "?", "it's", "a\\nb", "tab\tnl\ncr\r", "\\", "'", '"', "x,y", "%", "é 😀", None, "\\'"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    files.write_arff(df, str(tmp_path / "t"))
    assert {r.i: r.t for r in files.scan_arff(spark, str(tmp_path / "t")).collect()} == dict(enumerate(texts))


def test_arff_many_files_and_no_rows(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("double").alias("n"), F.concat(F.lit("t "), "id").alias("my text"))
    files.write_arff(df.repartition(40), str(tmp_path / "many"))
    got = files.scan_arff(spark, str(tmp_path / "many"))
    assert got.dtypes == df.dtypes and sorted(got.collect()) == sorted(df.collect())
    files.write_arff(df.filter("n < 0"), str(tmp_path / "none"))
    got = files.scan_arff(spark, str(tmp_path / "none"))
    assert got.dtypes == df.dtypes and got.count() == 0


def test_arff_columns_of_one_name_and_none(spark, tmp_path):
    (tmp_path / "a.arff").write_text("@relation t\n@attribute \"it's\" REAL \n@attribute x string\n@attribute x string\n@data\n1,u,v\n")
    (tmp_path / "b.arff").write_text("@relation t\n@data\n3\n")
    got = files.scan_arff(spark, str(tmp_path))
    assert got.columns == ["it's", "x"]
    assert sorted(((r["it's"], r.x) for r in got.collect()), key=str) == [(1.0, "u"), (None, None)]
