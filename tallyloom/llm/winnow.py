"""Document fingerprints by winnowing, in DataFrame functions only.

Every text is winnowed twice, by one rule at every length. Its units are words (runs of characters other than U+0020 and U+0009
to U+000D); in a run of more than RUN_CHARS characters each further one is a unit of its own, as is each character of scripts
that are written without spaces, so no unit is long. And the first HEAD_CHARS code points of a text are units of their own,
blanks left out, so that texts of a few words have many units too. Units are hashed; a rolling hash by cyclic shifts covers
every GRAM_UNITS of them; of every WINDOW_GRAMS rolling hashes (HEAD_WINDOW in the head) the smallest is kept, the rightmost on
ties, with its position. The first windows grow from one gram. Two texts that share a run of GRAM_UNITS + WINDOW_GRAMS - 1
units share a fingerprint, as do two texts that begin with the same GRAM_UNITS units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

GRAM_UNITS = 5
WINDOW_GRAMS = 4
RUN_CHARS = 24
HEAD_CHARS, HEAD_WINDOW = 64, 2
BLANKS, LONE = r"[\x20\x09-\x0D]+", r"[⺀-￿\x{10000}-\x{10FFFF}]"
UNIT_BREAK = rf"{BLANKS}|(?<={LONE})|(?<=[^\x20\x09-\x0D]{{{RUN_CHARS}}})"
#: A window's order: 31 bits of a gram's hash above 32 bits that hold the position counted from the right.
TOP = (1 << 32) - 1
ORDER_BITS = (1 << 31) - 1
DOCS_PER_RANGE = 2048
#: Boundaries of id ranges are found by two steps of at most RANGE_STEP comparisons.
RANGE_STEP = 128


def _rotate(c: Column, by: int) -> Column:
    return F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by))


def _tail(c: Column, drop: int) -> Column:
    return F.slice(c, F.lit(drop + 1), F.greatest(F.size(c) - drop, F.lit(0)))


def _pairs(a: Column, ahead: int, other: Column, f) -> Column:
    """f over a[i] and other[i + ahead], for the i that have both."""
    late = _tail(other, ahead)
    return F.zip_with(F.slice(a, F.lit(1), F.size(late)), late, f)


def units(text: Column) -> Column:
    words = F.split(text, BLANKS, -1)
    # without a long run and a lone character, words are all units there are
    fine = F.exists(words, lambda w: F.octet_length(w) > RUN_CHARS) | text.rlike(LONE)
    return F.array_remove(F.when(fine, F.split(text, UNIT_BREAK, -1)).otherwise(words), "")


def head_units(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.substring(text, 1, HEAD_CHARS), BLANKS, ""), "", -1), "")


def _winnowed(df: DataFrame, units_: Column, window: int, out: str) -> DataFrame:
    """``df`` with ``out`` and ``out``_at: the grams that windows of ``window`` (a power of two) choose, and where they are."""
    h, g, two, four = (f"__wn_{out}_{x}" for x in ("h", "g", "two", "four"))
    empty = F.array().cast("array<bigint>")
    df = df.withColumn(h, F.transform(units_, lambda x: F.xxhash64(x)))
    df = df.withColumn(two, _pairs(F.col(h), 1, F.col(h), lambda a, b: _rotate(a, 1).bitwiseXOR(b)))
    df = df.withColumn(four, _pairs(F.col(two), 2, F.col(two), lambda a, b: _rotate(a, 2).bitwiseXOR(b)))
    five = _pairs(F.col(four), 4, F.col(h), lambda a, b: F.xxhash64(_rotate(a, 1).bitwiseXOR(b)))
    short = F.when(F.size(h) > 0, F.array(F.xxhash64(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: _rotate(a, 1).bitwiseXOR(x))))).otherwise(empty)
    df = df.withColumn(g, F.when(F.size(h) >= GRAM_UNITS, five).otherwise(short))
    rank = F.transform(g, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(ORDER_BITS)), 32).bitwiseOR(F.lit(TOP) - i))
    df = df.withColumn(four, F.concat(F.array_repeat(F.lit(2**63 - 1), window - 1), rank))
    covered = 1
    while covered < window:
        source, covered = four if covered == 1 else two, covered * 2
        df = df.withColumn(two, _pairs(F.col(source), covered // 2, F.col(source), lambda a, b: F.least(a, b)))
    df = df.withColumn(f"{out}_at", F.transform(F.array_distinct(two), lambda x: (F.lit(TOP) - x.bitwiseAND(F.lit(TOP))).cast("int")))
    df = df.withColumn(out, F.transform(f"{out}_at", lambda i: F.get(F.col(g), i)))
    return df.drop(h, g, two, four)


def with_fingerprints(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``, the 64-bit hashes of the chosen grams, and ``out``_at, their positions: those of the head first, then
    those of the text, each in order.

    Positions are numbers of units from 0, those of the head are -1, -2 and so on; a gram that is chosen at several places is
    listed for each. A null text counts as empty. Without units both arrays are empty; with fewer than GRAM_UNITS units all
    units make one gram.
    """
    text, head, body = F.coalesce(F.col(text_col), F.lit("")), f"__wn_{out}_head", f"__wn_{out}_body"
    df = _winnowed(_winnowed(df, head_units(text), HEAD_WINDOW, head), units(text), WINDOW_GRAMS, body)
    at = F.concat(F.transform(f"{head}_at", lambda i: -1 - i), F.col(f"{body}_at"))
    return df.withColumns({out: F.concat(head, body), f"{out}_at": at}).drop(head, f"{head}_at", body, f"{body}_at")


def digest(prints: Column, at: Column) -> Column:
    """Lower-case hex SHA-256 of the fingerprints with their positions."""
    return F.sha2(F.array_join(F.zip_with(prints, at, lambda x, i: F.concat(F.hex(x), F.lit("@"), i.cast("string"))), " "), 256)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Jaccard likeness of two arrays of distinct hashes; 1 if both are empty."""
    shared = f"__wn_{out}_shared"
    df = df.withColumn(shared, F.size(F.array_intersect(a, b)))
    union = F.size(a) + F.size(b) - F.col(shared)
    return df.withColumn(out, F.when(union == 0, F.lit(1.0)).otherwise(F.col(shared).cast("double") / union)).drop(shared)


def _ranges(docs: DataFrame, id_col: str) -> list[int]:
    """Boundaries that deal ids into ranges of about DOCS_PER_RANGE rows; at most RANGE_STEP ** 2 numbers reach the driver."""
    n = docs.count()
    parts = max(1, min(RANGE_STEP**2, n // DOCS_PER_RANGE))
    if parts == 1:
        return []
    at = docs.agg(F.percentile_approx(id_col, F.array(*(F.lit(i / parts) for i in range(1, parts))), 10 * parts).alias("at")).first()["at"]
    return sorted(set(at or []))


def _part(id_: Column, cuts: list[int]) -> Column:
    """The range of an id, by comparison with every RANGE_STEP-th boundary and then with those that follow it."""
    rows = [cuts[i : i + RANGE_STEP] for i in range(0, len(cuts), RANGE_STEP)]
    if not rows:
        return F.lit(0)
    below = lambda c: F.size(F.filter(c, lambda x: x <= id_))
    longs = lambda x: F.array(*(F.lit(c).cast("long") for c in x))
    row = F.greatest(below(longs([r[0] for r in rows])) - 1, F.lit(0))
    return F.when(id_.isNull(), F.lit(0)).otherwise(row * RANGE_STEP + below(F.get(F.array(*map(longs, rows)), row)))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, prints, prints_at, next_text, next_prints) with the document that follows by id; the first follows the last.

    Documents are dealt into ranges of ids. What follows a range's last document is found among the ranges' first ids alone,
    a row a range, and only those documents' texts are read again. Null ids come first; rows of one id are ordered by the
    hash of their text. Ids have to be whole numbers.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to be a column of whole numbers")
    cuts = _ranges(docs, id_col)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = slim.withColumns({"key": F.xxhash64("text"), "part": _part(F.col("id"), cuts)})
    order = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "key")
    heads = keyed.groupBy("part").agg(F.min(order).alias("head"))
    turn, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(F.col("part").alias("edge_part"), F.coalesce(F.lead("head").over(turn), F.first("head").over(whole)).alias("e"))  # one row a range
    found = slim.withColumn("key", F.xxhash64("text")).withColumn("o", order).join(F.broadcast(after), F.col("o") == F.col("e"))
    edge = with_fingerprints(found.groupBy("edge_part").agg(F.first("text").alias("edge_text")), "edge_text", "edge_prints")
    dealt = with_fingerprints(keyed.repartition("part"), "text", "prints")
    by = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "key")
    led = dealt.withColumns({"next": F.lead(F.struct("text", "prints")).over(by)})
    out = led.join(edge, F.col("part") == F.col("edge_part"), "left")
    last = F.col("next").isNull()
    return out.select("id", "text", "prints", "prints_at", F.when(last, F.col("edge_text")).otherwise(F.col("next.text")).alias("next_text"), F.when(last, F.col("edge_prints")).otherwise(F.col("next.prints")).alias("next_prints"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document, with their likeness.

    The edited text has the last floor(n/4) code points replaced by as many first code points of the next document, or by
    all it has. Cases: null text is empty; a text without units has no fingerprints, two such texts are alike (1); under
    about seven characters the edit may change every gram (likeness 0); equal rows follow each other; an empty table gives no
    rows; texts of any length are read whole. Extra columns of the input, whatever their names, aren't read. Returns id_col,
    n_chars, edited_text, prints, prints_at, edited_prints, edited_prints_at, near_edited, near_next.
    """
    rows = neighbours(docs, id_col, text_col)
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = with_fingerprints(rows.withColumn("edited_text", edited), "edited_text", "edited_prints")
    rows = rows.withColumns({"__a": F.array_distinct("prints"), "__b": F.array_distinct("edited_prints"), "__c": F.array_distinct("next_prints")})
    rows = with_likeness(with_likeness(rows, "__a", "__b", "near_edited"), "__a", "__c", "near_next")
    return rows.select(F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), "edited_text", "prints", "prints_at", "edited_prints", "edited_prints_at", "near_edited", "near_next")
