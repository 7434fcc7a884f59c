"""An entity's particulars, proposed by many sources in a fixed order: the first proposal fills a blank, the others are kept."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.periods import days_between_periods, is_fiscal, period_plus_one_year, short_period
from tallyloom.functions.scalars import days_in_year

#: Fields that a filing's face gives, in order, with the face's column; and the least share of a shareholder.
FACE = [("legalName", "name"), ("addr1", "addr1"), ("addr2", "addr2"), ("addr3", "addr3"), ("formed", "formed"), ("countryInc", "country"), ("activity", "activity"), ("currency", "currency"), ("refId", "ref_id"), ("principalPlace", "place"), ("activityCode", "activity_code")]
TEN_PERCENT = 10.0
FACE_RANK, FOUND_RANK, LAST_RANK = 10, 100, 1_000


class Filled(NamedTuple):
    """``profile`` (entity_id, bucket, key, value) with blanks filled; ``provenance`` (entity_id, bucket, key, value, source) of what was
    filled; ``disagreements`` (entity_id, bucket, key, value, sources): other values that were proposed for a filled field."""

    profile: DataFrame
    provenance: DataFrame
    disagreements: DataFrame


def fill_blanks(profile: DataFrame, proposals: DataFrame) -> Filled:
    """Fill what ``profile`` (entity_id, bucket, key, value) has blank or not at all with the proposal of lowest (rank, ord).

    ``proposals`` are (entity_id, bucket, key, value, source, rank, ord); empty ones are none. Proposals are grouped by value first, so
    a field with very many is a few rows when the first is chosen.
    """
    key = ["entity_id", "bucket", "key"]
    values = proposals.where("value <> ''").groupBy(*key, "value").agg(F.min(F.struct("rank", "ord", "source")).alias("first"), F.count_distinct("source").alias("sources"))
    best = values.groupBy(*key).agg(F.min(F.struct("first", "value")).alias("best"))
    taken = profile.where("value <> ''").select(*key)
    filled = best.join(taken, key, "left_anti").select(*key, F.col("best.value").alias("value"), F.col("best.first.source").alias("source"))
    now = profile.join(filled.select(*key, F.col("value").alias("__new")), key, "full").select(*key, F.coalesce(F.nullif("value", F.lit("")), "__new", "value").alias("value"))
    others = values.join(filled.select(*key, F.col("value").alias("__new")), key).where("value <> __new").select(*key, "value", "sources")
    return Filled(now, filled, others)


def _rows(df: DataFrame, items: list[tuple[str, str, Column, Column, int]]) -> DataFrame:
    """(bucket, key, value, source, rank) items of each row as proposals."""
    made = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(k).alias("key"), v.cast("string").alias("value"), s.alias("source"), F.lit(r).alias("rank")) for b, k, v, s, r in items))
    return df.select("entity_id", F.inline(made)).where("coalesce(value, '') <> ''").withColumn("ord", F.lit(0).cast("bigint"))


def period_proposals(entities: DataFrame, faces: DataFrame) -> DataFrame:
    """Period ends from ``entities`` (entity_id, cy, py) and from the earlier filing's ``faces`` (entity_id, source, period_end).

    A fiscal period goes first, unless its next year isn't the entity's; then the years of the statements; then a calendar one.
    """
    both = entities.join(faces.select("entity_id", "source", "period_end"), "entity_id", "left")
    fiscal = is_fiscal(F.col("period_end"))
    year = F.right("period_end", F.lit(4)).try_cast("int")
    agrees = F.coalesce(year + 1 == F.col("cy"), F.lit(True)) | (year == 0)
    after, line = period_plus_one_year(F.col("period_end")), F.concat("source", F.lit(" · annual accounting period"))
    early, late = F.when(fiscal & agrees & after.isNotNull(), F.lit(1)), F.when(~fiscal & after.isNotNull(), F.lit(1))
    calendar = lambda y: F.concat(F.lit("12/31/"), F.right(y.cast("string"), F.lit(2)))
    stated = F.lit("statement year")
    return _rows(both, [
        ("profile", "cyEnd", F.when(early == 1, short_period(after)), line, 1), ("profile", "pyEnd", F.when(early == 1, short_period(F.col("period_end"))), line, 1),
        ("profile", "cyEnd", calendar(F.col("cy")), stated, 2), ("profile", "pyEnd", calendar(F.col("py")), stated, 2),
        ("profile", "cyEnd", F.when(late == 1, short_period(after)), line, 3), ("profile", "pyEnd", F.when(late == 1, short_period(F.col("period_end"))), line, 3),
    ])


def propose_profile(profile: DataFrame, entities: DataFrame, faces: DataFrame, found: DataFrame, sniffed: DataFrame) -> Filled:
    """Fill an entity's particulars: period ends, then the face of its earlier filing, then what documents say, then a currency.

    ``faces`` (entity_id, source, period_end, FACE's columns, pct_voting), one row an entity; ``found`` (entity_id, bucket, key, value,
    source, ord) as read from documents; ``sniffed`` (entity_id, value, source, ord) currencies for a profile that has none. A
    filing proposes the voting share, that the entity is controlled, a ten percent share unless it says less, and whole-year days:
    those of a fiscal period between the ends that were filled, else those of the entity's year. A blank is filled once.
    """
    periods = fill_blanks(profile, period_proposals(entities, faces))
    ends = periods.profile.where("bucket = 'profile'").groupBy("entity_id").agg(F.max(F.when(F.col("key") == "cyEnd", F.col("value"))).alias("cy_end"), F.max(F.when(F.col("key") == "pyEnd", F.col("value"))).alias("py_end"))
    facts = faces.join(entities.select("entity_id", "cy"), "entity_id", "left").join(ends, "entity_id", "left")
    face = F.concat("source", F.lit(" · 5471 face"))
    earlier = F.concat("source", F.lit(" · prior-year filing"))
    pct = F.col("pct_voting")
    shown = F.when(pct == pct.cast("long"), pct.cast("long").cast("string")).otherwise(pct.cast("string"))
    ten = F.when(pct.isNull() | (pct >= TEN_PERCENT), "Yes")
    fiscal_days = F.when(is_fiscal(F.col("period_end")), days_between_periods(F.col("py_end"), F.col("cy_end")))
    days = F.coalesce(fiscal_days, days_in_year(F.col("cy")))
    told = lambda what: F.when(fiscal_days.isNotNull(), F.lit(f"full fiscal-year {what}")).otherwise(F.lit(f"full-year {what}"))
    own = _rows(facts, [
        *(("profile", k, F.col(c), face, FACE_RANK) for k, c in FACE), ("ownership", "ownStart", shown, face, FACE_RANK), ("ownership", "ownEnd", shown, face, FACE_RANK), ("ownership", "cfc", F.lit("Yes"), earlier, FACE_RANK),
        ("ownership", "tenPct", ten, F.when(pct.isNotNull(), F.concat("source", F.lit(" · "), shown, F.lit("% voting per prior filing"))).otherwise(earlier), FACE_RANK),
        ("ownership", "daysCfc", days, told("CFC"), FACE_RANK), ("ownership", "daysOwned", days, told("ownership"), FACE_RANK),
    ])
    read = found.select("entity_id", "bucket", "key", "value", "source", F.lit(FOUND_RANK).alias("rank"), F.col("ord").cast("bigint").alias("ord"))
    last = sniffed.select("entity_id", F.lit("profile").alias("bucket"), F.lit("currency").alias("key"), "value", "source", F.lit(LAST_RANK).alias("rank"), F.col("ord").cast("bigint").alias("ord"))
    rest = fill_blanks(periods.profile, own.unionByName(read).unionByName(last))
    return Filled(rest.profile, periods.provenance.unionByName(rest.provenance), periods.disagreements.unionByName(rest.disagreements))
