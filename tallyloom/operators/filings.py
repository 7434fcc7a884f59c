"""Facts of an earlier filing, read from its printed pages: periods, the face's fields, holders, ids and amounts of lines.

Printed rows are (doc_id, page, row, cells), cells an array of (text, x0, x1). A caption's values stand in the rows below it on
its page, so each row is seen together with a few rows that follow: a window over one page. What the rows say becomes one value
a document by minima over (page, row).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import let, parse_number, strict_number
from tallyloom.operators.rows import once, whole_pages

#: Captions and layouts of the forms, months, and how far left of its caption a value may begin.
PERIOD_CAPTION = "annual accounting period"
FILER_TAIL = r"(?is)filer'?s tax year.*$"
DAY = r"(\d{1,2})\s*[-/]\s*(\d{1,2})\s*[-/,]\s*((?:19|20)\s?\d{2})"
NAMED_DAY = r"([A-Za-z]{3,9})\.?\s+(\d{1,2})\s*,?\s*((?:19|20)\s?\d{2})"
PERIOD_GAP = r"[\s\S]{0,240}?"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FIRST_YEAR, LAST_YEAR = 1990, 2100
FACTS_CAPTION = r"(?i)date of incorporation|principal place of business|functional currency code"
FACT_COLUMNS = [("d", r"date of incorp|^d\s+date\b"), ("e", r"principal place of business"), ("f", r"activity code"), ("g", r"principal business activity"), ("h", r"functional currency")]
NEXT_SECTION = r"(?i)^\d+\s+[a-z]|provide the following|schedule a\b"
NEXT_WORDS, PART_WORDS = ["provide the following", "schedule a"], ["activity", "code n", "incorporation", "number", "principal", "functional", "date of"]
CAPTION_PART = r"(?i)activity code|code no\.?|code number|^incorporation$|^number$|principal place|principal business|functional currency|^business activity$|^date of"
GLUED_DATE = r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b\s*(.*)$"
LONE_DATE = r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"
VOTING_CAPTION = r"(?i)stock you owned at the end|percentage of the foreign corporation'?s voting"
COUNTRY_CAPTION = r"(?i)country under whose laws incorporated"
COUNTRY_LINE = "country under whose laws"
NAME_CAPTION = r"(?i)^1a name and address of foreign corporation"
NO_VALUE = r"(?i)reference id|identif\w* number|previous reference|^instructions|country under whose laws|^[b-d]\(?\d?\)?\s|^\(?see instructions"
NO_WORDS = ["reference", "identif", "instructions", "country under"]
GLUED_ID = r"(?i)^([A-Z][A-Z0-9]{2,19})\s+b\(\d\)"
CATEGORY_CAPTION = r"(?i)category of filer"
#: Words, in lower case, one of which a caption row of a face holds, by what it captions; and those of fact columns.
VOTING_WORDS, COUNTRY_WORDS, CATEGORY_WORDS, NAME_WORDS = ["stock you owned at the end", "percentage of the"], ["country under whose"], ["category of filer"], ["name and address of"]
SHARE_WORDS, FACT_WORDS, COLUMN_WORDS = [" share"], ["date of incorp", "principal place", "functional currency"], ["date", "place", "activity", "currency"]
FACE_WORDS = [*VOTING_WORDS, *COUNTRY_WORDS, *CATEGORY_WORDS, *NAME_WORDS, *SHARE_WORDS, *FACT_WORDS]
CATEGORIES = ["1a", "1b", "1c", "2", "3", "4", "5a", "5b", "5c"]
TICKS = ["x", "✓", "✔"]
HOLDERS_CAPTION = r"(?i)part ii\b.*direct shareholders"
HOLDERS_END = r"(?i)^part\b|^schedule [a-z]\b(?!\s*,\s*column)|income statement"
SHARE_CLASS = r"(?i)^(common|ordinary|preferred|class [a-z0-9]+)( shares?)?$"
GLUED_COUNTS = r"^(\d[\d,]*\.\d{3})(\d[\d,]*\.\d{3})$"
LINE_NUMBER = r"^\d{1,2}[a-c]?\s+"
COLUMN_SLACK, NAME_SLACK = 12.0, 8.0
PERIOD_ROWS, VALUE_ROWS, NEXT_ROWS, NAME_ROWS, HOLDER_ROWS, ADDRESS_LINES = 4, 4, 3, 8, 40, 3


def line_text(cells: Column) -> Column:
    return F.array_join(cells["text"], " ")


def with_rows_below(printed: DataFrame, n: int) -> DataFrame:
    """``printed`` with ``below``, the cells of up to ``n`` rows that follow on the page."""
    return printed.withColumn("below", F.collect_list("cells").over(Window.partitionBy("doc_id", "page").orderBy("row").rowsBetween(1, n)))


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def day(parts: Column, at: int, named: bool) -> Column:
    """A date's printed form MM/DD/YYYY from three of ``parts``, null if it is none."""
    part = lambda i: F.get(parts, F.lit(at + i))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(0), 1, 3))).cast("int") if named else part(0).try_cast("int")
    read = F.struct(month.alias("m"), part(1).try_cast("int").alias("d"), F.regexp_replace(part(2), r"\s+", "").try_cast("int").alias("y"))
    return let(read, lambda r: F.when(r["m"].between(1, 12) & r["d"].between(1, 31) & r["y"].between(FIRST_YEAR, LAST_YEAR), F.format_string("%02d/%02d/%d", r["m"], r["d"], r["y"])))


def groups_of(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of the first match of ``pattern``, which hold no bar; null without a match."""
    split = lambda m: F.when(m != "", F.split(F.regexp_replace(m, pattern, "|".join(f"${i + 1}" for i in range(n))), r"\|"))
    return let(F.regexp_extract(text, pattern, 0), split)


def period_of(text: Column, whole: bool) -> Column:
    """(begin, end) of a text that holds both dates, or (null, end) of one with the end, or null; numbers before names."""
    def read(one: str, named: bool) -> Column:
        both = rf"(?i){PERIOD_CAPTION}{PERIOD_GAP}beginning\s*{one}\s*,?\s*(?:and\s*)?ending\s*{one}"
        last = rf"(?i){PERIOD_CAPTION}{PERIOD_GAP}ending\s*{one}"
        if whole:
            dates = let(groups_of(text, both, 6), lambda g: F.struct(day(g, 0, named).alias("begin"), day(g, 3, named).alias("end")))
            return let(dates, lambda p: F.when(p["begin"].isNotNull() & p["end"].isNotNull(), p))
        ends = let(groups_of(text, last, 3), lambda g: day(g, 0, named))
        return let(ends, lambda end: F.when(end.isNotNull(), F.struct(F.lit(None).cast("string").alias("begin"), end.alias("end"))))

    return F.coalesce(read(DAY, False), read(NAMED_DAY, True))


def parse_accounting_period(printed: DataFrame) -> DataFrame:
    """(doc_id, begin, end): the period that a document's caption announces, MM/DD/YYYY; documents without one have no row.

    A caption's text grows by one following row of its page at a time, up to PERIOD_ROWS; the first text that holds both dates
    wins, over all captions in order of print; else the first with an end. The filer's own tax year ends a text. Dates may be
    numbers or begin with a month's name and may be split over rows; impossible ones are none.
    """
    text = line_text(F.col("cells"))
    rows = printed.select("doc_id", "page", "row", text.alias("text"))
    rows = rows.withColumn("below", F.collect_list("text").over(Window.partitionBy("doc_id", "page").orderBy("row").rowsBetween(1, PERIOD_ROWS))).where(F.col("text").rlike(f"(?i){PERIOD_CAPTION}"))
    grown = F.transform(F.sequence(F.lit(0), F.size("below")), lambda k: F.struct(k.alias("k"), F.regexp_replace(F.concat_ws(" ", "text", F.slice("below", F.lit(1), k)), FILER_TAIL, "").alias("text")))
    texts = rows.select("doc_id", "page", "row", F.explode(grown).alias("t"))
    rank = lambda n, found: let(found, lambda p: F.when(p.isNotNull(), F.struct(F.lit(n).alias("n"), F.col("page").alias("page"), F.col("row").alias("row"), F.col("t.k").alias("k"), p.alias("p"))))
    best = F.coalesce(rank(0, period_of(F.col("t.text"), True)), rank(1, period_of(F.col("t.text"), False)))
    return texts.groupBy("doc_id").agg(F.min(best).alias("best")).where("best is not null").select("doc_id", "best.p.*")


def nearest_columns(captions: Column, rows: Column) -> Column:
    """Values by caption: the cells of ``rows`` (an array of rows), each with the key of the caption column that it stands in.

    ``captions`` are (x0, key) in order of x0. A cell belongs to the last caption that begins at most COLUMN_SLACK right of it;
    cells left of all captions belong to none.
    """
    column = lambda c: F.try_element_at(F.filter(captions, lambda a: a["x0"] - COLUMN_SLACK <= c["x0"]), F.lit(-1))["key"]
    cells = F.transform(F.flatten(rows), lambda c: F.struct(column(c).alias("key"), F.trim(c["text"]).alias("text")))
    return F.filter(cells, lambda c: c["key"].isNotNull())


def _says(low: Column, words: list[str]) -> Column:
    """Whether a text in lower case holds one of ``words``: told before patterns are tried, which need one of them."""
    return reduce(or_, (F.contains(low, F.lit(w)) for w in words))


def _until(rows: Column, stop: Callable[[Column], Column]) -> Column:
    """The rows before the first that ``stop`` holds for."""
    at = F.array_position(F.transform(rows, lambda r: F.coalesce(stop(r), F.lit(False))), F.lit(True))
    return let(at, lambda n: F.when(n > 0, F.slice(rows, F.lit(1), (n - 1).cast("int"))).otherwise(rows))


def _facts(r: Column) -> Column:
    """Date, place, code, activity and currency below a caption row ``r`` (row, cells, text, low, below) of a face, by the columns of
    their captions, and what a row with a date of its own says without columns."""

    def key(low: Column) -> Column:
        found = F.lit(None).cast("string")
        for k, pattern in reversed(FACT_COLUMNS):
            found = F.when(low.rlike(pattern), F.lit(k)).otherwise(found)
        return found

    words = lambda x: let(F.trim(F.array_join(x, " ")), lambda t: F.nullif(t, F.lit("")))
    whole = lambda t: ~(_says(F.lower(t), PART_WORDS) & t.rlike(CAPTION_PART))
    foreign = lambda t: t.rlike("^[A-Z]{3}$") & (t != "USD")
    at = lambda row, f: F.array_position(F.transform(row, f), F.lit(True)).cast("int")

    def read(values: Column, d: Column, lone: Column) -> Column:
        under = lambda k: F.filter(values, lambda v: v["key"] == k)["text"]
        date = F.nullif(F.regexp_extract(d, GLUED_DATE, 1), F.lit(""))
        behind = let(F.nullif(F.trim(F.regexp_extract(d, GLUED_DATE, 2)), F.lit("")), lambda t: F.when(whole(t), t))
        place = F.coalesce(words(F.filter(under("e"), lambda t: t.rlike("^[A-Za-z][A-Za-z ,.'&-]*$") & whole(t))), behind)
        code = first_of(F.filter(F.transform(F.concat(under("f"), under("e"), under("g")), lambda t: F.regexp_extract(t, r"(?:^|\s)(\d{4,6})$", 1)), lambda t: t != ""))
        activity = words(F.filter(under("g"), lambda t: t.rlike("[A-Za-z]") & whole(t)))
        currency = first_of(F.filter(under("h"), lambda t: t.rlike("^[A-Z]{3}$")))
        ccy, date_at = at(lone, foreign), at(lone, lambda t: t.rlike(LONE_DATE))
        return F.struct(
            F.col("page"), r["row"].alias("row"), F.regexp_replace(date, "-", "/").alias("formed"), place.alias("place"), code.alias("code"), activity.alias("activity"), currency.alias("currency"),
            F.regexp_replace(first_of(F.filter(lone, lambda t: t.rlike(LONE_DATE))), "-", "/").alias("formed2"), first_of(F.filter(lone, foreign)).alias("currency2"), F.when((ccy > 0) & (ccy - 1 > date_at), F.get(lone, ccy - 2)).alias("activity2"),
        )

    anchors = F.transform(r["cells"], lambda c, i: F.struct(c["x0"].alias("x0"), i.alias("i"), let(F.trim(F.lower(c["text"])), lambda low: F.when(_says(low, COLUMN_WORDS), key(low))).alias("key")))
    placed = F.sort_array(F.filter(anchors, lambda a: a["key"].isNotNull()))
    ends = lambda t: (t.rlike("^[0-9]") | _says(F.lower(t), NEXT_WORDS)) & t.rlike(NEXT_SECTION)
    near = _until(F.slice(r["below"], 1, VALUE_ROWS), lambda x: let(F.trim(line_text(x)), ends))
    values = let(placed, lambda a: F.when(F.size(a) >= 2, nearest_columns(a, near)))
    # without columns: the first following row with a date of its own
    plain = lambda rows: F.transform(rows, lambda x: F.filter(F.transform(x["text"], lambda t: F.trim(t)), lambda t: t != ""))
    dated = first_of(F.filter(plain(F.slice(r["below"], 1, NEXT_ROWS)), lambda x: F.exists(x, lambda t: t.rlike(LONE_DATE))))
    lone = F.when(F.contains(r["low"], F.lit("date of incorporation")), dated)
    said = let(values, lambda v: let(words(F.filter(v, lambda x: x["key"] == "d")["text"]), lambda d: let(lone, lambda row: read(v, d, row))))
    return F.when(_says(r["low"], FACT_WORDS) & r["text"].rlike(FACTS_CAPTION), said)


def _fields_of(r: Column) -> dict[str, Column]:
    """What a caption row ``r`` (row, cells, text, low, below) of a face says, by field; null where it captions something else."""
    near = F.slice(r["below"], 1, NEXT_ROWS)
    with_own = F.concat(F.array(r["cells"]), near)
    voting = F.regexp_extract(first_of(F.filter(F.transform(with_own, line_text), lambda t: F.contains(t, F.lit("%")) & t.rlike(r"\d{1,3}(\.\d+)?\s*%"))), r"(\d{1,3}(?:\.\d+)?)\s*%", 1).try_cast("double")
    country = first_of(F.filter(F.transform(first_of(r["below"])["text"], lambda t: F.trim(t)), lambda t: t.rlike("^[A-Za-z][A-Za-z ]{2,30}$")))
    ticked = lambda tokens: F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(CATEGORIES) & F.get(tokens, i + 1).isin(TICKS), t)), lambda t: t.isNotNull())
    marked = F.filter(F.transform(with_own, lambda x: F.lower(line_text(x))), lambda t: _says(t, TICKS))
    marks = first_of(F.filter(F.transform(marked, lambda t: let(F.split(t, r"\s+"), ticked)), lambda x: F.size(x) > 0))
    bound = F.get(r["cells"], F.lit(1))["x0"] - NAME_SLACK
    left = lambda x, edge: F.trim(F.coalesce(F.get(F.when(edge.isNull(), x).otherwise(F.filter(x, lambda c: c["x0"] < edge))["text"], F.lit(0)), F.lit("")))
    line = F.array_position(F.transform(r["below"], lambda x: F.contains(F.lower(line_text(x)), F.lit(COUNTRY_LINE))), F.lit(True)).cast("int")
    block = let(line, lambda n: F.when(n > 0, F.slice(r["below"], F.lit(1), n + 1)).otherwise(r["below"]))
    told = let(bound, lambda edge: F.filter(F.transform(block, lambda x: left(x, edge)), lambda t: t.rlike("[A-Za-z]") & ~((t.rlike("^[b-dB-D]") | _says(F.lower(t), NO_WORDS)) & t.rlike(NO_VALUE)) & ~(F.contains(t, F.lit("(")) & t.rlike(GLUED_ID) & F.regexp_extract(t, GLUED_ID, 1).rlike(r"\d"))))
    named_by = lambda said, name: F.struct(name.alias("name"), F.slice(F.filter(said, lambda t: t != name), 1, ADDRESS_LINES).alias("address"))
    named = let(told, lambda said: F.when(F.size(said) > 0, let(first_of(said), lambda name: named_by(said, name))))
    texts = r["cells"]["text"]
    class_at = F.array_position(F.transform(texts, lambda t: F.trim(t).rlike(r"(?i)^(ordinary|common|class [a-z]) shares?$")), F.lit(True)).cast("int")
    number = lambda x: F.coalesce(strict_number(x), parse_number(x))  # noqa: E731  (the same number, sooner where it is printed plainly)
    counts = lambda k: F.filter(F.transform(F.slice(texts, k + 1, F.size(texts)), number), lambda n: n.isNotNull())
    held = lambda k, n: F.when((F.size(n) >= 2) & (F.get(n, F.lit(0)) >= 0) & (F.get(n, F.lit(1)) >= 0), F.struct(F.trim(F.get(texts, k - 1)).alias("class"), F.get(n, F.lit(0)).alias("boy"), F.get(n, F.lit(1)).alias("eoy")))
    shares = let(class_at, lambda k: F.when(k > 0, let(counts(k), lambda n: held(k, n))))
    meets = lambda words, text, pattern: _says(r["low"], words) & text.rlike(pattern)
    return {
        "pct_voting": F.when(meets(VOTING_WORDS, r["text"], VOTING_CAPTION), voting), "country": F.when(meets(COUNTRY_WORDS, r["text"], COUNTRY_CAPTION), country), "categories": F.when(meets(CATEGORY_WORDS, r["text"], CATEGORY_CAPTION), marks),
        "named": F.when(meets(NAME_WORDS, F.trim(F.get(texts, F.lit(0))), NAME_CAPTION), named), "shares": F.when(_says(r["low"], SHARE_WORDS), shares),
    }


def face_fields(printed: DataFrame) -> DataFrame:
    """A document's face: (doc_id, name, address, country, formed, place, activity_code, activity, currency, pct_voting,
    categories, shares).

    ``printed`` are the rows of its face pages, or pages as in whole_pages. Captions are met in order of print and the first value
    found stays; address is an array of at most ADDRESS_LINES, categories an array of ticked codes, shares (class, boy, eoy). What
    isn't found is null. The name stands in the column of its caption, left of the next caption, at most up to the row behind that of
    the country. Of the facts below captions in columns, each caption row of two captions or more gives what stands below it; later
    ones add to it up to the first with a date. A page is read in its own array; only what it says goes by document.
    """
    lines = F.transform("rows", lambda r, i: let(line_text(r["cells"]), lambda t: F.struct(i.alias("i"), t.alias("text"), F.lower(t).alias("low"))))
    pages = once(whole_pages(printed), "met", F.filter(lines, lambda x: _says(x["low"], FACE_WORDS)))
    row = lambda x: F.struct(F.get("rows", x["i"])["row"].alias("row"), F.get("rows", x["i"])["cells"].alias("cells"), x["text"].alias("text"), x["low"].alias("low"), F.transform(F.slice("rows", x["i"] + 2, F.lit(NAME_ROWS)), lambda r: r["cells"]).alias("below"))
    read = lambda r: F.struct(F.col("page").alias("page"), r["row"].alias("row"), *(v.alias(k) for k, v in _fields_of(r).items()), _facts(r).alias("facts"))
    said = F.transform("met", lambda x: let(row(x), read))
    # captions of one document are few
    read = once(pages, "said", said).groupBy("doc_id").agg(F.flatten(F.collect_list(F.when(F.size("said") > 0, F.col("said")))).alias("said"))
    first = lambda k: F.array_min(F.transform("said", lambda r: F.when(r[k].isNotNull(), F.struct(r["page"].alias("page"), r["row"].alias("row"), r[k].alias("v")))))
    fields = ("pct_voting", "country", "categories", "named", "shares")
    folded = read.select("doc_id", *(first(k).alias(k) for k in fields), F.sort_array(F.array_compact(F.col("said")["facts"])).alias("all"))
    ends = F.array_position(F.transform("all", lambda r: F.coalesce(r["formed"], r["formed2"]).isNotNull()), F.lit(True)).cast("int")
    found = folded.withColumn("used", F.when(ends > 0, F.slice("all", F.lit(1), ends)).otherwise(F.col("all")))
    last = lambda k: F.try_element_at(F.filter("used", lambda r: r[k].isNotNull()), F.lit(-1))[k]
    end = F.try_element_at("used", F.lit(-1))
    spare = lambda k: F.when(end["formed"].isNull(), end[k])
    return found.select(
        "doc_id", F.col("named.v.name").alias("name"), F.col("named.v.address").alias("address"), F.col("country.v").alias("country"), F.coalesce(end["formed"], end["formed2"]).alias("formed"), last("place").alias("place"),
        last("code").alias("activity_code"), F.coalesce(last("activity"), spare("activity2")).alias("activity"), F.coalesce(last("currency"), spare("currency2")).alias("currency"),
        F.col("pct_voting.v").alias("pct_voting"), F.col("categories.v").alias("categories"), F.col("shares.v").alias("shares"),
    )


def share_counts(cells: Column) -> Column:
    """The numbers in an array of cells, split at blanks; two counts printed as one are two."""
    tokens = F.filter(F.flatten(F.transform(cells, lambda t: F.split(F.trim(t), r"\s+"))), lambda t: t != "")
    number = lambda t, i: F.replace(F.regexp_extract(t, GLUED_COUNTS, i), F.lit(","), F.lit("")).try_cast("double")
    numbers = F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(GLUED_COUNTS), F.array(number(t, 1), number(t, 2))).otherwise(F.array(strict_number(t)))))
    return F.filter(numbers, lambda n: n.isNotNull())


def shareholder_rows(printed: DataFrame) -> DataFrame:
    """(doc_id, place, page, name, class, boy, eoy, single): direct holders of a document's face pages, in order of print.

    Rows behind the section's caption, up to the next section or HOLDER_ROWS rows, that name a class of shares and a count at
    each end of the year, or one count for both (``single``). The name stands before the class, or first in the row below where
    only an identifier does. Of holders of one name, whatever its case, the first stays.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("page", "row")
    texts = F.filter(F.transform(F.col("cells")["text"], lambda t: F.trim(t)), lambda t: t != "")
    text = F.trim(line_text(F.col("cells")))
    rows = printed.select("doc_id", "page", "row", text.alias("text"), texts.alias("t"), F.trim(F.get(F.col("cells"), F.lit(0))["text"]).alias("head"))
    rows = rows.withColumns({"at": F.row_number().over(by_doc), "after": F.lead("head").over(by_doc)})
    whole = Window.partitionBy("doc_id")
    rows = rows.withColumn("start", F.min(F.when(F.col("text").rlike(HOLDERS_CAPTION), F.col("at"))).over(whole)).where("at > start and at < start + " + str(HOLDER_ROWS))
    rows = rows.withColumn("stop", F.min(F.when(F.col("text").rlike(HOLDERS_END), F.col("at"))).over(whole)).where("stop is null or at < stop").where(F.size("t") >= 2)
    class_at = F.array_position(F.transform("t", lambda x: x.rlike(SHARE_CLASS)), F.lit(True)).cast("int")
    held = once(once(rows, "c", class_at).where("c > 0"), "counts", share_counts(F.slice("t", F.col("c") + 1, F.size("t"))))
    pair = (F.size("counts") >= 2) & (F.get("counts", F.lit(0)) >= 0) & (F.get("counts", F.lit(1)) >= 0)
    lone = strict_number(F.get("t", F.col("c")))
    whole_year = lambda n, at: F.when(F.col("single"), F.when(n >= 0, n)).otherwise(F.get("counts", F.lit(at)))
    held = once(held.withColumn("single", ~pair), "lone", F.when(F.col("single"), lone)).withColumns({"boy": whole_year(F.col("lone"), 0), "eoy": whole_year(F.col("lone"), 1)}).where("boy is not null")
    id_like = lambda x: x.rlike(r"^\d{2}-\d{7}\b|^\d{3}-\d{2}-\d{4}\b|^[A-Z]{2}$") | ~x.rlike("[A-Za-z]{3}")
    own = F.trim(F.array_join(F.slice("t", F.lit(1), F.greatest(F.col("c") - 1, F.lit(0))), " "))
    below = F.when(F.col("after").rlike("[A-Za-z]{3}") & ~F.col("after").rlike(NO_VALUE), F.col("after"))
    held = once(held, "name", let(own, lambda t: F.when((t == "") | id_like(t), F.coalesce(below, t)).otherwise(t))).where((F.col("name") != "") & ~id_like(F.col("name")) & ~F.col("name").rlike(r"(?i)name, address|^\(a\)"))
    kept = held.groupBy("doc_id", F.lower("name").alias("low")).agg(F.min(F.struct("at", "page", "name", F.regexp_replace(F.get("t", F.col("c") - 1), r"(?i)\s*shares?$", "").alias("class"), "boy", "eoy", "single")).alias("h"))
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("h.at")).alias("place"), "h.page", "h.name", "h.class", "h.boy", "h.eoy", "h.single")


def ref_id_token(text: Column) -> Column:
    """A reference id: seven to nine digits, or a letter and three or more letters and digits with a digit; null if it is none."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{7,9}$"), t).when(t.rlike("(?i)^[A-Z][A-Z0-9]{3,19}$") & t.rlike(r"\d"), F.upper(t))


def split_glued_ref_id(text: Column) -> Column:
    """The id that stands before the next caption in one cell, or null."""
    part = F.regexp_extract(F.trim(text), GLUED_ID, 1)
    return F.when(part.rlike(r"\d"), F.upper(part))


def reference_ids(printed: DataFrame) -> DataFrame:
    """(doc_id, ids): ids on rows that speak of a reference id and on the row below each, distinct, as first seen."""
    rows = with_rows_below(printed, 1).where(line_text(F.col("cells")).rlike("(?i)reference id"))
    cells = F.concat(F.col("cells")["text"], F.coalesce(first_of(F.col("below"))["text"], F.array().cast("array<string>")))
    found = rows.select("doc_id", "page", "row", F.posexplode(F.transform(cells, lambda t: F.coalesce(split_glued_ref_id(t), ref_id_token(t)))).alias("k", "id")).where("id is not null")
    firsts = found.groupBy("doc_id", "id").agg(F.min(F.struct("page", "row", "k")).alias("at"))
    return firsts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "id")))["id"].alias("ids"))


def match_form_lines(printed: DataFrame, lines: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, key, page, value) of the first row for each of ``lines`` (key, pattern, pick).

    A cell whose text, without a line number before it, meets the pattern captions its row; the value is the first or last
    (``pick``) of the strict numbers right of it, without a repeated line number in front. Rows without a number are passed over.
    """
    cells = F.col("cells")["text"]
    rows = printed.select("doc_id", "page", "row", cells.alias("t"), F.transform(cells, strict_number).alias("n"))
    spots = rows.select("doc_id", "page", "row", "t", "n", F.posexplode("t").alias("i", "cell"))
    bare = F.regexp_replace(F.trim("cell"), LINE_NUMBER, "")
    keys = [F.when(bare.rlike(p), F.struct(F.lit(k).alias("key"), F.lit(pick).alias("pick"))) for k, p, pick in lines]
    met = spots.where("trim(cell) <> ''").select("doc_id", "page", "row", "t", "n", "i", "cell", F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("k"))
    right = F.filter(F.slice("n", F.col("i") + 2, F.size("n")), lambda x: x.isNotNull())
    before = F.get("t", F.col("i") - 1)
    number = F.coalesce(F.nullif(F.regexp_extract(F.trim("cell"), r"^(\d{1,2})[a-c]?\b", 1), F.lit("")), F.nullif(F.regexp_extract(F.trim(before), r"^(\d{1,2})[a-c]?$", 1), F.lit(""))).try_cast("double")
    met = met.withColumn("right", right).withColumn("right", F.when((F.size("right") > 1) & (F.get("right", F.lit(0)) == number), F.slice("right", F.lit(2), F.size("right"))).otherwise(F.col("right"))).where(F.size("right") > 0)
    value = F.when(F.col("k.pick") == "first", F.get("right", F.lit(0))).otherwise(F.element_at("right", F.lit(-1)))
    best = met.groupBy("doc_id", "k.key").agg(F.min(F.struct("page", "row", "i", value.alias("value"))).alias("b"))
    return best.select("doc_id", "key", "b.page", "b.value")
