"""Kinds of pages from their printed text, and blocks of pages that belong to one filing.

Printed rows are (doc_id, page, row, cells), or pages (doc_id, page, rows) of them; a page's rows are as many as fit on it, so its
text is one array. What depends on
other pages is found in windows over a document's pages, which carry kinds and names, not texts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import let
from tallyloom.operators.cases import name_tokens, token_overlap
from tallyloom.operators.layout import inherit_kinds
from tallyloom.operators.rows import once

HEAD_ROWS, FOOT_ROWS, TITLE_ROWS = 14, 3, 5
FACE, FILING = "us-5471-face", "us-5471-"
SIMILAR = 0.5

#: What tells a form, a statutory document and an export; the rules of pages in their order, each with the scope in

FORM_5471 = r"form\s*5471\b|\(form 5471\)"
BAND_HEAD = r"\babn\b|\bacn\b|\ba\.\s?b\.\s?n\.?\b|company\s+(no\.?\s|number|registration)|registered\s+(number|office)|companies house"
BAND_FOOT = r"page \d+ of \d+"
BAND_WORDS = ["abn", "acn", "b.", "company", "registered", "companies"]
PERIOD_TITLE = r"^(as of .*\d{4}|(january|february|march|april|may|june|july|august|september|october|november|december)[\s\S]{0,40}\d{4}|all dates)$"
SCHEDULE_PAGE = r"schedule ([a-z])(?:-1)?\s*\(form 5471\)"
SCHEDULE_LETTERS = "abcefhijmopr"
PAGE_RULES = [
    ("any", "head", r"form\s*5472\b", "us-5472", 3, ["5472"]),
    ("any", "head", r"form\s*8992\b|\(form 8992\)", "us-8992", 3, ["8992"]),
    ("any", "head", r"federal supporting statements", "us-statements", 3, ["federal supporting"]),
    ("form", "head", r"accumulated earnings\s*&?\s*profits", "us-5471-schJ", 3, ["accumulated earnings"]),
    ("form", "head", r"transactions between controlled foreign corporation", "us-5471-schM", 3, ["transactions between"]),
    ("form", "head", r"income, war profits, and excess profits taxes", "us-5471-schE", 3, ["war profits"]),
    ("form", "head", r"current earnings and profits", "us-5471-schH", 3, ["current earnings"]),
    ("form", "head", r"previously taxed earnings and profits", "us-5471-schP", 3, ["previously taxed"]),
    ("form", "head", r"distributions from a foreign corporation", "us-5471-schR", 3, ["distributions from"]),
    ("form", "head", r"organization or reorganization of foreign corporation", "us-5471-schO", 3, ["reorganization"]),
    ("form", "head", r"information return of u\.?s\.? persons", "us-5471-face", 3, ["information return"]),
    ("form", "letter", "", "us-5471-sch", 3, []),
    ("form", "all", r"(?s)schedule c\b.*income statement|income statement.*schedule c\b", "us-5471-schC", 2, ["income statement"]),
    ("form", "all", r"(?s)schedule f\b.*balance sheet|balance sheet.*schedule f\b", "us-5471-schF", 2, ["balance sheet"]),
    ("form", "head", r"schedule i\b|summary of shareholder", "us-5471-schI", 2, ["schedule i", "summary of"]),
    ("form", "all", r"schedule b\b|u\.?s\.? shareholders of foreign corporation", "us-5471-schB", 2, ["schedule b", "shareholders of"]),
    ("form", "all", r"schedule a\b|stock of the foreign corporation", "us-5471-schA", 2, ["schedule a", "stock of"]),
    ("form", "all", r"", "us-5471-face", 2, []),
    ("any", "head", r"form\s*1120\b|\(form 1120\)|u\.?s\.? corporation income tax return", "us-1120", 3, ["1120", "income tax return"]),
    ("any", "head", r"form\s*(851|1125-e|1125e|7004|4562)\b", "us-other", 2, ["851", "1125", "7004", "4562"]),
    ("any", "head", r"company tax return\s*\d{4}", "ato-return", 3, ["company tax return"]),
    ("any", "head", r"franking account", "ato-franking", 3, ["franking"]),
    ("any", "head", r"dividend and interest schedule", "ato-dividend-schedule", 3, ["dividend and"]),
    ("any", "head", r"calculation statement", "ato-calc-statement", 2, ["calculation"]),
    ("band", "head", r"\bcontents\b|directors'? (statement|report)|accountants'? report|compilation report|independent auditor", "fs-cover", 3, ["contents", "directors", "report", "independent auditor"]),
    ("assumed", "head", r"accounting policies|notes to the (accounts|financial statements)", "fs-notes", 2, ["accounting policies", "notes to the"]),
    ("band", "head", r"trading account", "fs-trading", 3, ["trading"]),
    ("band", "head", r"statement of financial position|balance sheet", "fs-balance-sheet", 3, ["financial position", "balance sheet"]),
    ("band", "head", r"statement of changes in equity", "fs-equity", 3, ["changes in equity"]),
    ("band", "all", r"opening retained (profits|earnings)|retained (profits|earnings) at the (beginning|start)|movements? in equity", "fs-equity", 3, ["retained", "in equity"]),
    ("band", "head", r"statement of financial performance|profit (and|or) loss|income statement|statement of comprehensive income", "fs-pnl", 3, ["financial performance", " loss", "income statement", "comprehensive income"]),
    ("band", "head", r"accounting policies|notes to ", "fs-notes", 2, ["accounting policies", "notes to "]),
    ("band", "head", r"financial statements", "fs-cover", 2, ["financial statements"]),
    ("export", "titles", r"^balance sheet(\s*[-–]\s*\d{4})?$", "fs-balance-sheet", 2, ["balance sheet"]),
    ("export", "titles", r"^(profit (and|&) loss|income statement|statement of activity)(\s*[-–]\s*\d{4})?$", "fs-pnl", 2, ["loss", "income statement", "statement of activity"]),
    ("any", "head", r"terms\s*(&|and)\s*conditions|letter of engagement|engagement terms", "tandc", 2, ["conditions", "engagement"]),
]
CONTINUABLE = ["us-5471-schJ", "us-5471-schE", "us-5471-schM", "us-5471-schP", "fs-balance-sheet", "fs-pnl", "fs-trading", "fs-equity", "us-statements", "ato-return", "tandc"]


def page_texts(printed: DataFrame) -> DataFrame:
    """(doc_id, page, head, foot, all, titles): a page's first, last and all rows in lower case, one a line, and its first
    rows each for itself.

    ``printed`` are rows, or pages (doc_id, page, rows) with their rows in order of print, which need not be put together.
    """
    line = lambda cells: F.lower(F.array_join(cells["text"], " "))
    if "rows" in printed.columns:
        lines = once(printed.select("doc_id", "page", "rows"), "lines", F.transform("rows", lambda r: line(r["cells"])))
    else:
        lines = printed.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("row", line(F.col("cells")).alias("text"))))["text"].alias("lines"))
    joined = lambda x: F.array_join(x, "\n")
    lines_ = F.col("lines")
    return lines.select(
        "doc_id",
        "page",
        joined(F.slice(lines_, 1, HEAD_ROWS)).alias("head"),
        joined(F.slice(lines_, F.greatest(F.size(lines_) - (FOOT_ROWS - 1), F.lit(1)), F.lit(FOOT_ROWS))).alias("foot"),
        joined(lines_).alias("all"),
        F.transform(F.slice(lines_, 1, TITLE_ROWS), lambda t: F.trim(t)).alias("titles"),
    )


def _matches(text: Column, pattern: str, words: list[str]) -> Column:
    """Whether ``text`` meets ``pattern``, which is only tried on texts with one of ``words``."""
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words)) & text.rlike(pattern)


def page_kind(assumed: bool) -> Column:
    """(kind, score) of a page of page_texts by the first of PAGE_RULES that holds; unknown and 0 if none does.

    ``assumed`` takes the page for one of a statutory document whatever it prints.
    """
    titled = lambda p: F.exists("titles", lambda t: t.rlike(p))
    band = F.lit(True) if assumed else _matches(F.col("head"), BAND_HEAD, BAND_WORDS) | _matches(F.col("foot"), BAND_FOOT, [" of "])
    # many rules ask for a scope, which is found once a page
    form = _matches(F.col("head"), FORM_5471, ["5471"])
    found_once = F.struct(form.alias("form"), band.alias("band"), titled(PERIOD_TITLE).alias("export"), F.when(form, F.regexp_extract("head", SCHEDULE_PAGE, 1)).otherwise(F.lit("")).alias("letter"))
    made = lambda kind, score: F.struct(kind.alias("kind"), F.lit(score).alias("score"))

    def judge(seen: Column) -> Column:
        scopes = {"any": F.lit(True), "form": seen["form"], "band": seen["band"], "assumed": F.lit(assumed), "export": seen["export"]}
        letter, rule = seen["letter"], None
        for scope, part, pattern, kind, score, words in PAGE_RULES:
            if part == "letter":
                holds, found = (letter != "") & F.lit(SCHEDULE_LETTERS).contains(letter), F.concat(F.lit(kind), F.upper(letter))
            else:
                holds, found = titled(pattern) if part == "titles" else _matches(F.col(part), pattern, words) if pattern else F.lit(True), F.lit(kind)
            rule = (F.when if rule is None else rule.when)(scopes[scope] & holds, made(found, score))
        assert rule is not None
        return rule.otherwise(made(F.lit("unknown"), 0))

    return let(found_once, judge)


def classify_pages(printed: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, kind, score) of all printed pages, and of blank ones too if ``pages`` (doc_id, page) lists them.

    ``printed`` are rows or pages as in page_texts; with pages by document nothing is shuffled.

    A page's own text decides first. In a document with a page of statutory statements, pages that stay unknown are judged as
    if they belonged to one. Then unknown pages take over the kind before them where that kind goes on over pages (score 1).
    Texts are judged where the page is put together; only kinds reach the windows over a document.
    """
    judged = once(page_texts(printed), "own", page_kind(False)).withColumn("statutory", F.when(F.col("own.kind") == "unknown", page_kind(True))).select("doc_id", "page", "own", "statutory")
    if pages is not None:
        judged = pages.select("doc_id", "page").distinct().join(judged, ["doc_id", "page"], "left")
    is_fs = F.max(F.coalesce(F.col("own.kind").startswith("fs-"), F.lit(False))).over(Window.partitionBy("doc_id"))
    kinds = judged.withColumn("__fs", is_fs).withColumn("__k", F.when((F.coalesce(F.col("own.kind"), F.lit("unknown")) == "unknown") & F.col("__fs"), F.col("statutory")).otherwise(F.col("own")))
    kinds = kinds.select("doc_id", "page", F.coalesce("__k.kind", F.lit("unknown")).alias("kind"), F.coalesce("__k.score", F.lit(0)).alias("score"))
    return inherit_kinds(kinds.withColumn("__known", F.col("kind") != "unknown"), CONTINUABLE).select("doc_id", "page", "kind", F.when(~F.col("__known") & (F.col("kind") != "unknown"), 1).otherwise(F.col("score")).alias("score"))


def raw_blocks(pages: DataFrame) -> DataFrame:
    """Pages with ``block``, ``in_family``: every face page opens a block, as does a document's first page of a filing.

    A block holds all pages up to the next one; what stands before the first belongs to it.
    """
    by_page = Window.partitionBy("doc_id").orderBy("page")
    family = F.col("kind").startswith(FILING)
    flagged = pages.withColumn("in_family", family).withColumn("__seen", F.sum(family.cast("int")).over(by_page.rowsBetween(Window.unboundedPreceding, -1)))
    opens = family & ((F.col("kind") == FACE) | (F.coalesce("__seen", F.lit(0)) == 0))
    return flagged.withColumn("block", F.greatest(F.sum(opens.cast("int")).over(by_page), F.lit(1))).withColumn("__any", F.max(family).over(Window.partitionBy("doc_id"))).where("__any").drop("__seen", "__any")


def segment_blocks(pages: DataFrame, names: DataFrame, ids: DataFrame) -> DataFrame:
    """The filings that one document staples together: (doc_id, index, pages, scan_from, scan_to, face_page, name, reference_ids).

    ``pages`` are all pages (doc_id, page, kind); ``names`` (doc_id, page, ord, name) and ``ids`` (doc_id, page, ord, id) what was
    read on them, ``ord`` in order of print. A block's pages are those of the filing, its range goes on to the next face. It has
    the name that its pages give most often (the first of equally frequent ones) and the ids of its range in order. Blocks
    without a name before the first named one join it, later ones the block before; then a block whose name shares half of the
    smaller name's words with the block before joins that one, which keeps its name. Documents without such pages have no rows.
    """
    placed = raw_blocks(pages)
    at = placed.select("doc_id", "page", "block", "in_family")
    said = names.where("name is not null").join(at.where("in_family"), ["doc_id", "page"]).groupBy("doc_id", "block", "name").agg(F.count("*").alias("n"), F.min(F.struct("page", "ord")).alias("first"))
    named = said.groupBy("doc_id", "block").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "name"))["name"].alias("name"))
    blocks = at.groupBy("doc_id", "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("in_family"), F.col("page")))).alias("pages"),
        F.min("page").alias("low"),
        F.max("page").alias("high"),
    )
    faces = placed.where(F.col("kind") == FACE).groupBy("doc_id", "block").agg(F.min("page").alias("face_page"))
    blocks = blocks.join(faces, ["doc_id", "block"], "left").join(named, ["doc_id", "block"], "left")
    # blocks of a document, in order, with the named block that each belongs to
    whole = blocks.withColumn("part", F.greatest(F.count("name").over(Window.partitionBy("doc_id").orderBy("block")), F.lit(1)))
    heads = whole.groupBy("doc_id", "part").agg(F.min(F.struct(F.col("name").isNull().alias("none"), "block", "name"))["name"].alias("name"))
    listed = heads.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", name_tokens(F.col("name")).alias("words")))).alias("parts"))

    def follow(state: Column, p: Column) -> Column:
        # the words of the block that is open, the index of the last block, and each part's index
        joins = token_overlap(state["words"], p["words"]) >= SIMILAR
        index = F.when(joins, state["index"]).otherwise(state["index"] + 1)
        return F.struct(F.when(joins, state["words"]).otherwise(p["words"]).alias("words"), index.alias("index"), F.concat(state["made"], F.array(F.struct(p["part"].alias("part"), index.alias("index")))).alias("made"))

    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(-1).alias("index"), F.array().cast("array<struct<part:bigint,index:int>>").alias("made"))
    parts = listed.select("doc_id", F.inline(F.aggregate("parts", start, follow)["made"]))
    indexed = whole.join(parts, ["doc_id", "part"])
    lead = F.min(F.struct(F.col("part"), F.col("name").isNull().alias("none"), "block", "face_page", "name"))
    merged = indexed.groupBy("doc_id", "index").agg(F.sort_array(F.flatten(F.collect_list("pages"))).alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), lead.alias("lead"))
    found = ids.where("id is not null").join(at, ["doc_id", "page"]).join(indexed.select("doc_id", "block", "index"), ["doc_id", "block"])
    seen = found.groupBy("doc_id", "index", "id").agg(F.min(F.struct("page", "ord")).alias("first")).groupBy("doc_id", "index").agg(F.sort_array(F.collect_list(F.struct("first", "id")))["id"].alias("reference_ids"))
    out = merged.join(seen, ["doc_id", "index"], "left")
    return out.select("doc_id", "index", "pages", F.col("low").alias("scan_from"), F.col("high").alias("scan_to"), F.col("lead.face_page").alias("face_page"), F.col("lead.name").alias("name"), F.coalesce("reference_ids", F.array().cast("array<string>")).alias("reference_ids"))
