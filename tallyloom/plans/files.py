"""Queries of delimited files, written from line items in three dialects, and of the languages of captions, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.languages import detect_language
from tallyloom.session import fresh_path, table
from tallyloom.sources.delimited import read_delimited_rows

#: Line items by dialect: keys tell rows apart, names may hold another dialect's separators.
_ITEMS = """SELECT concat('k', l_orderkey, '-', n) AS k, CASE l_orderkey % 3 WHEN 0 THEN 'tsv' WHEN 1 THEN 'csv' ELSE 'txt' END AS kind, p_name, l_extendedprice AS price, n FROM (
 SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) i JOIN part ON l_partkey = p_partkey"""
_CAPTION = """SELECT l_orderkey * 100 + n AS id, CASE n % 8 WHEN 0 THEN p_name WHEN 1 THEN concat('現金 ', p_name) WHEN 2 THEN concat(p_name, ' Gastos') WHEN 3 THEN concat('Créances ', p_name) WHEN 4 THEN concat(p_name, ' à') WHEN 5 THEN concat('ñ ', p_name) WHEN 6 THEN concat('Größe ', p_name) ELSE concat(p_name, ' Выручка') END AS label FROM (
 SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) i JOIN part ON l_partkey = p_partkey"""


def _base(spark: SparkSession, d: str) -> None:
    for x in ("lineitem", "part"):
        table(spark, d, x).createOrReplaceTempView(x)


def delimited_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every cell with its row's key and its file's rows, read back from files of the three dialects with empty lines between."""
    _base(spark, d)
    items = spark.sql(_ITEMS)
    folder = fresh_path(spark, "delimited")
    for kind, sep in (("tsv", "\t"), ("csv", ","), ("txt", ";")):
        price = F.format_string("%.2f", "price")
        cells = [F.col("k"), F.concat(F.lit('"'), F.col("p_name"), F.lit('" ' if kind == "txt" else '"')), F.concat(F.lit(" "), price), F.lit("a,b" if kind == "tsv" else "")]
        lines = items.where(F.col("kind") == kind).select(F.explode(F.array(F.concat_ws(sep, *cells), F.lit(""))).alias("line"))
        lines.write.option("extension", kind).option("sep", "\u0001").option("quote", "\u0000").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{kind}")
    rows = read_delimited_rows(spark, folder)
    return rows.select(F.col("cells")[0].alias("k"), F.lower(F.substring_index("path", ".", -1)).alias("kind"), F.posexplode("cells").alias("col", "text"))


def languages_of_captions(spark: SparkSession, d: str) -> DataFrame:
    _base(spark, d)
    return spark.sql(_CAPTION).select("id", detect_language(F.col("label")).alias("language"))


def languages_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, by script, words and letters."""
    return table(spark, d, "documents").select("doc_id", detect_language(F.col("text")).alias("language"))


_QUERIES = (delimited_cells, languages_of_captions, languages_of_documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_DOCUMENTS = r"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'Arabic' WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'Japanese' WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'Chinese'
 WHEN regexp_matches(text, '[\x{AC00}-\x{D7AF}]') THEN 'Korean' WHEN regexp_matches(text, '[\x{0400}-\x{04FF}]') THEN 'Cyrillic' WHEN regexp_matches(text, '[\x{0370}-\x{03FF}]') THEN 'Greek' WHEN regexp_matches(text, '[\x{0590}-\x{05FF}]') THEN 'Hebrew'
 WHEN regexp_matches(text, '[\x{0900}-\x{097F}]') THEN 'Devanagari' WHEN regexp_matches(text, '[\x{0980}-\x{09FF}]') THEN 'Bengali' WHEN regexp_matches(text, '[\x{0B80}-\x{0BFF}]') THEN 'Tamil' WHEN regexp_matches(text, '[\x{0C00}-\x{0C7F}]') THEN 'Telugu'
 WHEN regexp_matches(text, '[\x{0A80}-\x{0AFF}]') THEN 'Gujarati' WHEN regexp_matches(text, '[\x{0E00}-\x{0E7F}]') THEN 'Thai' WHEN len(list_intersect(string_split(lower(text), ''), string_split('ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ', ''))) > 0 THEN 'Vietnamese'
 WHEN list_bool_or(list_transform(['achats', 'charges', 'produits', 'créances', 'dettes', 'immobilisations', 'amortissements', 'loyer', 'société', 'trésorerie', 'capital social'], lambda w: contains(lower(text), w))) THEN 'French'
 WHEN list_bool_or(list_transform(['ingresos', 'gastos', 'cuenta', 'clientes', 'proveedores', 'inmovilizado', 'existencias', 'capital', 'banco'], lambda w: contains(lower(text), w))) THEN 'Spanish'
 WHEN list_bool_or(list_transform(['umsatz', 'aufwand', 'ertrag', 'forderungen', 'verbindlichkeiten', 'anlagevermögen', 'kapital'], lambda w: contains(lower(text), w))) THEN 'German'
 WHEN list_bool_or(list_transform(['receita', 'despesa', 'clientes', 'fornecedores', 'imobilizado', 'capital'], lambda w: contains(lower(text), w))) THEN 'Portuguese'
 WHEN list_bool_or(list_transform(['ricavi', 'costi', 'crediti', 'debiti', 'immobilizzazioni', 'capitale'], lambda w: contains(lower(text), w))) THEN 'Italian'
 WHEN len(list_intersect(string_split(lower(text), ''), string_split('àâçéèêëîïôûùüÿœ', ''))) > 0 THEN 'French' WHEN len(list_intersect(string_split(lower(text), ''), string_split('áéíóúñ¿¡', ''))) > 0 THEN 'Spanish'
 WHEN len(list_intersect(string_split(lower(text), ''), string_split('äöüß', ''))) > 0 THEN 'German' ELSE 'English' END AS language FROM documents"""


def oracle_sql() -> dict[str, str]:
    return {
        "delimited_cells": f"SELECT k, kind, c.col, CASE c.col WHEN 0 THEN k WHEN 1 THEN CASE WHEN kind = 'txt' THEN p_name || '\"' ELSE p_name END WHEN 2 THEN format('{{:.2f}}', price) ELSE CASE WHEN kind = 'tsv' THEN 'a,b' ELSE '' END END AS text FROM ({_ITEMS}) i, (VALUES (0), (1), (2), (3)) c(col)",
        "languages_of_captions": f"SELECT id, CASE id % 100 % 8 WHEN 1 THEN 'Chinese' WHEN 2 THEN 'Spanish' WHEN 3 THEN 'French' WHEN 4 THEN 'French' WHEN 5 THEN 'Spanish' WHEN 6 THEN 'German' WHEN 7 THEN 'Cyrillic' ELSE 'English' END AS language FROM ({_CAPTION})",
        "languages_of_documents": _DOCUMENTS,
    }
