"""The language that a caption seems to be in: by script, then by words, then by letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.scalars import let

#: Scripts in the order in which they are asked, words of statements, and letters that tell a language.
SCRIPTS = [
    ("Arabic", "[\\u0600-\\u06FF]"), ("Japanese", "[\\u3040-\\u30FF]"), ("Chinese", "[\\u4E00-\\u9FFF]"), ("Korean", "[\\uAC00-\\uD7AF]"), ("Cyrillic", "[\\u0400-\\u04FF]"), ("Greek", "[\\u0370-\\u03FF]"), ("Hebrew", "[\\u0590-\\u05FF]"),
    ("Devanagari", "[\\u0900-\\u097F]"), ("Bengali", "[\\u0980-\\u09FF]"), ("Tamil", "[\\u0B80-\\u0BFF]"), ("Telugu", "[\\u0C00-\\u0C7F]"), ("Gujarati", "[\\u0A80-\\u0AFF]"), ("Thai", "[\\u0E00-\\u0E7F]"),
    ("Vietnamese", "(?iu)[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"),
]
WORDS = [
    ("French", ["achats", "charges", "produits", "créances", "dettes", "immobilisations", "amortissements", "loyer", "société", "trésorerie", "capital social"]),
    ("Spanish", ["ingresos", "gastos", "cuenta", "clientes", "proveedores", "inmovilizado", "existencias", "capital", "banco"]),
    ("German", ["umsatz", "aufwand", "ertrag", "forderungen", "verbindlichkeiten", "anlagevermögen", "kapital"]),
    ("Portuguese", ["receita", "despesa", "clientes", "fornecedores", "imobilizado", "capital"]),
    ("Italian", ["ricavi", "costi", "crediti", "debiti", "immobilizzazioni", "capitale"]),
]
LETTERS = [("French", "[àâçéèêëîïôûùüÿœ]"), ("Spanish", "[áéíóúñ¿¡]"), ("German", "[äöüß]")]


def detect_language(label: Column) -> Column:
    """The first script that a caption has a letter of, else the first language with one of its words anywhere in it, else the
    first with one of its letters, else English; null for null."""
    # texts are lowered once, and scripts and letters looked for among what isn't ASCII; words have only to be contained
    low, rare = "low", "rare"
    given = F.struct(F.lower(label).alias(low), F.regexp_replace(label, "[\\x00-\\x7F]+", "").alias(rare))

    def named(x: Column) -> Column:
        stages = [(name, x[rare].rlike(p)) for name, p in SCRIPTS] + [(name, reduce(Column.__or__, (F.contains(x[low], F.lit(w)) for w in words))) for name, words in WORDS]
        stages += [(name, F.lower(x[rare]).rlike(p)) for name, p in LETTERS]
        out = F.when(x[low].isNull(), F.lit(None))
        for name, holds in stages:
            out = out.when(holds, name)
        return out.otherwise("English")

    return let(given, named)
