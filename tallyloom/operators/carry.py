"""Which earlier filing an entity goes on from, which filings are copies of it, and which belong to entities of their own."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.cases import name_tokens, token_overlap

SIMILAR = 0.5


def dedupe_carry_forward(candidates: DataFrame) -> DataFrame:
    """``candidates`` (entity_id, ord, name, ref_ids, pages, ...) with ``place``, their number among those kept, null for copies.

    In order of ``ord`` a candidate is a copy of the first kept one that shares a reference id with it or half of the smaller
    name's words; the one with more pages keeps the place, the earlier one of equally many. A candidate without name and ids
    is nobody's copy. The candidates are the filings stapled in one entity's documents; they are folded as one array with
    their words and ids only.
    """
    slim = candidates.select("entity_id", F.struct("ord", F.coalesce("ref_ids", F.array().cast("array<string>")).alias("ids"), name_tokens(F.col("name")).alias("words"), F.coalesce("pages", F.lit(0)).cast("int").alias("pages")).alias("c"))
    listed = slim.groupBy("entity_id").agg(F.sort_array(F.collect_list("c")).alias("all"))

    def add(kept: Column, c: Column) -> Column:
        same = lambda k: F.arrays_overlap(k["ids"], c["ids"]) | (token_overlap(k["words"], c["words"]) >= SIMILAR)
        at = F.array_position(F.transform(kept, lambda k: F.coalesce(same(k), F.lit(False))), F.lit(True))
        better = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (c["pages"] > k["pages"]), c).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(c))).otherwise(better)

    folded = listed.withColumn("kept", F.aggregate("all", F.filter("all", lambda c: F.lit(False)), add))
    places = folded.select("entity_id", F.posexplode("kept").alias("place", "k")).select("entity_id", "place", F.col("k.ord").alias("ord"))
    return candidates.join(places, ["entity_id", "ord"], "left")


class Selected(NamedTuple):
    """``chosen``: the filing that each entity goes on from; ``siblings``: other named filings; ``review``: (entity_id, level,
    kind, ord) of what has to be looked at."""

    chosen: DataFrame
    siblings: DataFrame
    review: DataFrame


def select_carry_forward(kept: DataFrame, entities: DataFrame) -> Selected:
    """Choose for each of ``entities`` (entity_id, known_name, cy) among its kept filings (entity_id, place, name, year, ...).

    The filing whose name is most like the known one, by half of the smaller name's words at least, of equal ones the first;
    else the first without a name; else none, and each is warned of. Without a known name the first one. A filing older than
    the year before the entity's is warned of, as are other filings without a name.
    """
    met = kept.where("place is not null").join(entities.select("entity_id", "known_name", "cy"), "entity_id")
    has_known = F.coalesce(F.col("known_name") != "", F.lit(False))
    named = F.coalesce(F.col("name") != "", F.lit(False))
    like = token_overlap(name_tokens(F.col("known_name")), name_tokens(F.col("name")))
    rank = F.when(~has_known, F.struct(F.lit(0).alias("tier"), F.lit(0.0).alias("unlike"), F.col("place").alias("place"))).when(named & (like >= SIMILAR), F.struct(F.lit(0).alias("tier"), (-like).alias("unlike"), F.col("place").alias("place"))).when(~named, F.struct(F.lit(1).alias("tier"), F.lit(0.0).alias("unlike"), F.col("place").alias("place")))
    best = met.groupBy("entity_id").agg(F.min(rank)["place"].alias("best"))
    judged = met.join(best, "entity_id").withColumns({"__named": named, "__is": F.coalesce(F.col("place") == F.col("best"), F.lit(False))})
    own = kept.columns
    old = F.col("__is") & (F.col("year") < F.col("cy") - 1)
    kind = F.when(old, "older year").when(F.col("best").isNull(), "other entity").when(~F.col("__is") & ~F.col("__named"), "without name")
    review = judged.withColumn("kind", kind).where("kind is not null").select("entity_id", F.lit("warn").alias("level"), "kind", "ord")
    return Selected(judged.where("__is").select(*own), judged.where("not __is and __named").select(*own), review)


def sibling_entities(siblings: DataFrame, existing: DataFrame) -> DataFrame:
    """Of ``siblings`` (owner_id, entity_id, ord, name, ref_ids, ...) those that no entity of their owner is yet.

    ``existing`` are (owner_id, name, ref_id). One is the same by reference id, or by half of the smaller name's words. Names meet
    on words within an owner, and only pairs that share one are counted.
    """
    key = ["owner_id", "entity_id", "ord"]
    by_id = siblings.select(*key, F.explode("ref_ids").alias("ref_id")).join(existing.where("ref_id <> ''").select("owner_id", "ref_id").distinct(), ["owner_id", "ref_id"], "left_semi").select(*key)
    told = existing.select("owner_id", name_tokens(F.col("name")).alias("theirs")).distinct()
    words = told.where(F.size("theirs") > 0).select("owner_id", F.size("theirs").alias("m"), F.xxhash64(F.array_sort("theirs")).alias("other"), F.explode("theirs").alias("word"))
    mine = siblings.select(*key, name_tokens(F.col("name")).alias("w")).select(*key, F.size("w").alias("n"), F.explode("w").alias("word"))
    by_name = mine.join(words, ["owner_id", "word"]).groupBy(*key, "other", "n", "m").agg(F.count("*").alias("shared")).where(F.col("shared") / F.least("n", "m") >= SIMILAR).select(*key)
    return siblings.join(by_id.unionByName(by_name).distinct(), key, "left_anti")
