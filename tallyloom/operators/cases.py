"""Cases of an entity: fingerprints and years of documents, feeds of pages, related parties, and the lists that users see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import norm, parse_number

#: Words of a company's name that don't tell it apart from others, words that aren't a group's name, the feeds of
#: each kind of page, and wordings of what is owed.
NAME_STOP = ["pty", "ltd", "limited", "inc", "llc", "corp", "corporation", "co", "gmbh", "plc", "the"]
GROUP_STOP = ["pty", "ltd", "limited", "inc", "llc", "corp", "corporation", "the", "and", "solutions", "americas", "group"]
STATEMENT_FEEDS = {
    "fs-trading": ["generic-is", "profile"], "fs-pnl": ["generic-is", "profile"], "fs-balance-sheet": ["generic-bs", "profile"], "fs-equity": ["equity"], "fs-cover": ["profile"], "fs-notes": ["profile"],
    "ato-return": ["targeted-ato"], "ato-calc-statement": ["targeted-ato"], "ato-dividend-schedule": ["targeted-ato"], "ato-franking": ["targeted-ato"],
}
STATEMENT_KINDS = ["cfc-financial-statements", "cfc-tax-return"]
RECEIVABLE = r"\bdr\b|debtor|receivable|owed by|due from|loan to"
PAYABLE = r"\bcr\b|creditor|payable|owed to|due to|loan from"


def value_fingerprint(cells: DataFrame, least: float = 100) -> DataFrame:
    """(doc_id, value): the distinct rounded sizes of ``least`` or more of a document's cells without words."""
    n = F.abs(parse_number(F.col("text")))
    return cells.where(~F.col("text").rlike("[A-Za-z]{2,}")).select("doc_id", n.alias("n")).where(F.col("n") >= least).select("doc_id", F.floor(F.col("n") + 0.5).cast("long").alias("value")).distinct()


def derive_case_years(docs: DataFrame) -> DataFrame:
    """(entity_id, cy, py, dissent) from documents (entity_id, kind, year, duplicate): the newest year of statements and
    returns that are no duplicates, the year before, and the other years, newest first."""
    voted = docs.where(F.col("kind").isin(STATEMENT_KINDS) & ~F.coalesce("duplicate", F.lit(False)) & F.col("year").isNotNull()).select("entity_id", "year").distinct()
    years = voted.groupBy("entity_id").agg(F.sort_array(F.collect_set("year"), asc=False).alias("y"))  # years are few
    cy = F.get("y", F.lit(0))
    return years.select("entity_id", cy.alias("cy"), (cy - 1).alias("py"), F.slice("y", F.lit(2), F.size("y")).alias("dissent"))


def feeds_of(kind: Column, page_kind: Column, duplicate: Column) -> Column:
    """The feeds that a page of a document may reach; none for duplicates and for what has no feed."""
    none = F.array(F.lit("none"))
    listed = F.create_map(*(x for k, v in STATEMENT_FEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    pages = F.coalesce(F.try_element_at(listed, page_kind), none)
    us = F.when(page_kind.startswith("us-5471-"), F.array(F.lit("carry-forward"))).otherwise(none)
    trial = F.array(F.lit("generic-is"), F.lit("generic-bs"), F.lit("profile"))
    own = F.when(kind.isin(STATEMENT_KINDS), pages).when(kind == "prior-year-us-return", us).when(kind == "related-party-ledger", F.array(F.lit("schM-ledger"))).when(kind == "trial-balance", trial)
    return F.when(F.coalesce(duplicate, F.lit(False)), none).otherwise(F.coalesce(own, none))


def pages_for_feed(pages: DataFrame, feed: str) -> DataFrame:
    """Pages (doc_id, page, kind, page_kind, duplicate) that may reach ``feed``."""
    return pages.where(F.array_contains(feeds_of(F.col("kind"), F.col("page_kind"), F.col("duplicate")), feed))


def name_tokens(name: Column, stop: list[str] = NAME_STOP) -> Column:
    """Distinct words of a company's name in lower case, without those that tell nothing."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]+", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(stop)))


def entity_similarity(a: Column, b: Column) -> Column:
    """The share of the smaller name's words that both names have; 0 if one has none."""
    return token_overlap(name_tokens(a), name_tokens(b))


def token_overlap(x: Column, y: Column) -> Column:
    """The share of the smaller array's words that both arrays have; 0 if one is empty or null."""
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def group_stems(names: DataFrame) -> DataFrame:
    """(entity_id, word): words of four letters or more in names (entity_id, name) of an entity's group."""
    return names.select("entity_id", F.explode(F.filter(name_tokens(F.col("name"), GROUP_STOP), lambda w: F.length(w) >= 4)).alias("word")).distinct()


def label_words(low: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)))


def route_related_party(captions: DataFrame, names: DataFrame) -> DataFrame:
    """``captions`` (entity_id, label, feed, target, ...) under names of the entity's group (entity_id, name): an unmatched
    balance caption that names one of them and speaks of what is owed becomes a loan asset or a loan liability.

    A caption's words meet the names' words of four letters or more in an equi-join within the entity.
    """
    stems = group_stems(names)
    low = F.lower("label")
    open_ = captions.where("target is null and feed = 'bs'").select("entity_id", low.alias("low")).distinct()
    words = open_.withColumn("word", F.explode(label_words(F.col("low"))))
    named = words.join(stems, ["entity_id", "word"], "left_semi").select(F.col("entity_id").alias("__e"), F.col("low").alias("__low")).distinct().withColumn("__named", F.lit(True))
    joined = captions.join(named, (F.col("entity_id") == F.col("__e")) & (low == F.col("__low")), "left")
    loan = F.when(low.rlike(RECEIVABLE), "loan-asset").when(low.rlike(PAYABLE), "loan-liability")
    routed = F.when(F.col("target").isNull() & (F.col("feed") == "bs") & F.col("__named"), loan).otherwise(F.col("target"))
    return joined.withColumn("target", routed).drop("__e", "__low", "__named")


def list_workpapers(papers: DataFrame, documents: DataFrame) -> DataFrame:
    """Work papers (id, entity_name, updated_at) with their number of documents (workpaper_id)."""
    counts = documents.groupBy(F.col("workpaper_id").alias("id")).agg(F.count("*").alias("n"))
    return papers.join(counts, "id", "left").withColumn("documents", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def link_tasks(tasks: DataFrame, papers: DataFrame) -> DataFrame:
    """Tasks (task_id, entity_name, workpaper_id) without a work paper take the one of their entity's name, whatever its case;
    of several the one with the smallest id."""
    own = papers.groupBy(F.lower("entity_name").alias("__name")).agg(F.min("id").alias("__id"))
    joined = tasks.join(own, F.lower("entity_name") == F.col("__name"), "left")
    return joined.withColumn("workpaper_id", F.coalesce("workpaper_id", "__id")).drop("__name", "__id")


def filter_events(events: DataFrame, actor: int | None = None, kind: str | None = None) -> DataFrame:
    """Events of an actor, of a kind, or of both; a criterion that isn't given holds for all."""
    held = events if actor is None else events.where(F.col("user_id") == actor)
    return held if kind is None else held.where(F.col("event_type") == kind)


def equity_rollforward(rows: DataFrame) -> DataFrame:
    """(entity_id, opening, profit, dividends, closing): a missing closing balance is opening + profit - dividends, two places."""
    rolled = F.round(F.col("opening") + F.coalesce("profit", F.lit(0.0)) - F.coalesce("dividends", F.lit(0.0)), 2)
    return rows.withColumn("closing", F.coalesce("closing", rolled))


def labels_to_translate(bound: DataFrame, unmatched: DataFrame, translated: DataFrame) -> DataFrame:
    """Distinct labels (entity_id, label) of both tables that aren't among the translated ones."""
    both = bound.select("entity_id", "label").union(unmatched.select("entity_id", "label")).where("label is not null").distinct()
    return both.join(translated.select("entity_id", "label"), ["entity_id", "label"], "left_anti")


def all_review_items(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """Items (entity_id, id, level, origin): those derived now, and stored ones that weren't derived ("check") or still are.

    A stored item gives a derived one its dismissal.
    """
    now = derived.select("entity_id", "id", "level")
    kept = stored.where("origin <> 'check'").select("entity_id", "id", "level", "dismissed")
    seen = stored.select("entity_id", "id", F.col("dismissed").alias("__d")).groupBy("entity_id", "id").agg(F.max("__d").alias("dismissed"))
    again = now.join(seen, ["entity_id", "id"], "left").withColumn("dismissed", F.coalesce("dismissed", F.lit(False)))
    return again.select("entity_id", "id", "level", "dismissed").unionByName(kept.join(now.select("entity_id", "id"), ["entity_id", "id"], "left_anti"))


def filter_lines(lines: DataFrame, text: str | None = None, schedule: str | None = None, multi: bool = False, edited: bool = False) -> DataFrame:
    """Lines (target, label, schedule, multi, edited) under all criteria given; text is looked for in target and label, whatever its case."""
    held = lines
    if text:
        held = held.where(F.contains(F.lower(F.concat_ws(" ", "target", "label")), F.lit(text.lower())))
    if schedule:
        held = held.where(F.col("schedule") == schedule)
    if multi:
        held = held.where("multi")
    return held.where("edited") if edited else held


def top_shareholders(rows: DataFrame, first_slot: int = 19, slots: int = 8) -> DataFrame:
    """The first ``slots`` holders by ``ord`` of each entity (entity_id, name, shares, ord) in numbered slots; unused ones are blank."""
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy("ord"))
    taken = rows.withColumn("slot", n + (first_slot - 1)).where(F.col("slot") < first_slot + slots).select("entity_id", "slot", "name", "shares")
    every = rows.select("entity_id").distinct().withColumn("slot", F.explode(F.sequence(F.lit(first_slot), F.lit(first_slot + slots - 1))))
    return every.join(taken, ["entity_id", "slot"], "left").select("entity_id", "slot", F.coalesce("name", F.lit("")).alias("name"), "shares")


def currency_lookup(asked: DataFrame, currencies: DataFrame) -> DataFrame:
    """``asked`` (text) with the code that the text is, else that of the currency or country of this name, first in code order."""
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("p"), norm(F.col(c)).alias("k")) for i, c in enumerate(("code", "name", "country")))))
    listed = currencies.select("code", keys.alias("x")).select("code", "x.p", "x.k").where("k is not null")
    best = listed.groupBy("k").agg(F.min(F.struct("p", "code")).alias("b")).select("k", F.col("b.code").alias("found"))
    return asked.join(best, norm(F.col("text")) == F.col("k"), "left").drop("k").withColumnRenamed("found", "code")
