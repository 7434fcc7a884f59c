"""Files in three dialects, read in few and in many splits; languages of captions."""

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.languages import LETTERS, SCRIPTS, WORDS, detect_language
from tallyloom.plans import files
from tallyloom.sources.delimited import read_delimited_cells

FILES = {
    "a.csv": 'Name,"Net Sales",x;y\r\n\r\n"b",  1 ,\n\nlast,"q""q",z',
    "b.CSV": "a;b;c,d\n1,5;2;\n",
    "c.tsv": "a;b\tc,d\t\n\n\te\n",
    "d/e.txt": "\n1;2,3\n",  # the first line is empty: commas
    "f.txt": "".join(f"row {i}; {i}\n" + "\n" * (i % 3) for i in range(4000)),
    "g.pdf": "not,read\n",
    "h.csv": "",
}


def plain(name, text):
    first = text.split("\n")[0]
    sep = "\t" if name.lower().endswith(".tsv") else ";" if first.count(";") > first.count(",") else ","
    lines = [x for x in re.split("\r?\n", text) if x]
    return [(name.split("/")[-1], r, c, re.sub('^"|"$', "", cell).strip()) for r, line in enumerate(lines) for c, cell in enumerate(line.split(sep))]


@pytest.mark.parametrize("split", [1000, 1 << 27])
def test_cells_of_files_in_any_number_of_splits(spark, tmp_path, split):
    (tmp_path / "d").mkdir()
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        cells = read_delimited_cells(spark, f"file://{tmp_path}")
        got = sorted((r.path.split("/")[-1], r.row, r.col, r.text) for r in cells.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(x for name, text in FILES.items() if name not in ("g.pdf", "h.csv") for x in plain(name, text))


def test_languages_by_stage(spark):
    cases = {
        "売上 現金": "Chinese", "ひらがな 現金": "Japanese", "Выручка": "Cyrillic", "нет Umsatz": "Cyrillic", "Tổng tài sản": "Vietnamese", "UMSATZERLÖSE": "German", "Capital social": "French", "Capital": "Spanish", "Clientes": "Spanish",
        "Ricavi": "Italian", "Receita": "Portuguese", "été": "French", "año": "Spanish", "größer": "German", "Cash": "English", "": "English", None: None,
    }
    # é and ó are letters of Vietnamese words only with further signs; â and ê are in its list
    df = spark.createDataFrame([(k,) for k in cases], "label string").withColumn("language", detect_language(F.col("label")))
    assert {r.label: r.language for r in df.collect()} == cases


def test_cells_get_their_rows_key_without_a_join(spark):
    plan = files.delimited_cells(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # of the few blocks with their files and with the lines


def test_languages_of_odd_texts_with_texts_lowered_once(spark):
    """Signs whose case is told by more than their own letter, between ASCII; the text itself is lowered once and met by no pattern of words."""
    odd = ["K", "İ", "ı", "Å", "ẞ", "ΑΣ", "ǅ", "ﬁ", "ÀÉ", "ỸA", "Ơ", "Ñ", "\U00020000", "é", "CRÉANCES", "capital  social", "\x00", "SOCIÉTÉ", "Œ", "힯", "㄀"]
    texts = odd + [f"Cash {a} at {b}\nbank" for a in odd for b in odd]
    df = spark.createDataFrame([(t,) for t in texts], "label string")
    low = F.lower("label")
    stages = [(n, F.col("label").rlike(p)) for n, p in SCRIPTS] + [(n, low.rlike("|".join(w))) for n, w in WORDS] + [(n, low.rlike(p)) for n, p in LETTERS]
    plain = F.coalesce(*(F.when(holds, n) for n, holds in stages), F.lit("English"))
    got = df.withColumns({"language": detect_language(F.col("label")), "plain": plain})
    assert [(r.label, r.language) for r in got.collect() if r.language != r.plain] == []
    plan = df.select(detect_language(F.col("label")).alias("language"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(label") == 1
