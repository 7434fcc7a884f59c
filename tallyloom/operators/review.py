"""Events, policies, state tables and listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Policies on messages go along with every row in arrays of about so many.
POLICY_BLOCK = 2_000


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def readable(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that matches messages can read a regular expression."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def message_policies(policies: DataFrame) -> DataFrame:
    """Policies that judge a message, without those whose regular expression can't be read: these never hold."""
    texts = policies.where(~_given(F.col("m_id")) & ~_given(F.col("m_category")) & _given(F.col("m_message")))
    # rules that users typed, one at a time
    bad = [r.ord for r in texts.where("regex").select("ord", "m_message").toLocalIterator() if not readable(policies.sparkSession, "(?i)" + r.m_message)]
    return texts.where(~F.col("ord").isin(bad)) if bad else texts


def first_policy(review: DataFrame, policies: DataFrame) -> DataFrame:
    """``review`` (entity_id, id, level, category, message) under policies (ord, m_id, m_category, m_message, regex, action).

    The first policy by ``ord`` that holds decides: ``suppress`` drops the item, ``keep`` leaves its level, another action is
    the new level; ``action`` says which, null if none holds. A policy holds by its first criterion that is set, id, else
    category, else message; one without any never does. Messages match as text or regular expression, whatever their case.
    Items meet policies on ids and on categories in equi-joins with one row a key; policies on messages are arrays of about
    POLICY_BLOCK each that go along with every row, however many there are. No row is told from another by its ids, so equal
    and null ids are judged each for itself.
    """
    known = policies.select("ord", "m_id", "m_category", "m_message", F.coalesce("regex", F.lit(False)).alias("regex"), "action")
    best = F.min(F.struct("ord", "action"))
    by_id = known.where(_given(F.col("m_id"))).groupBy(F.col("m_id").alias("__m_id")).agg(best.alias("__by_id"))
    by_category = known.where(~_given(F.col("m_id")) & _given(F.col("m_category"))).groupBy(F.col("m_category").alias("__m_category")).agg(best.alias("__by_category"))
    joined = review.join(by_id, F.col("id").cast("string") == F.col("__m_id"), "left").join(by_category, F.col("category") == F.col("__m_category"), "left")
    texts = message_policies(known)
    blocks = -(-texts.count() // POLICY_BLOCK)
    low = F.lower("message")
    found = []
    for b in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == b)
        rules = mine.agg(F.sort_array(F.collect_list(F.struct("ord", "action", F.when(F.col("regex"), F.concat(F.lit("(?i)"), F.col("m_message"))).alias("pattern"), F.lower("m_message").alias("text")))).alias("r"))
        joined = joined.withColumn(f"__rules{b}", rules.scalar())
        held = F.filter(f"__rules{b}", lambda p: F.coalesce(F.when(p["pattern"].isNotNull(), F.regexp_like(F.col("message"), p["pattern"])).otherwise(F.contains(low, p["text"])), F.lit(False)))
        first = F.get(held, F.lit(0))
        found.append(F.when(first.isNotNull(), F.struct(first["ord"].alias("ord"), first["action"].alias("action"))))
    choices = [F.col("__by_id"), F.col("__by_category"), *found]
    joined = joined.withColumn("action", F.least(*choices)["action"]).drop("__m_id", "__by_id", "__m_category", "__by_category", *(f"__rules{b}" for b in range(blocks)))
    level = F.when(F.col("action").isNull() | (F.col("action") == "keep"), F.col("level")).otherwise(F.col("action"))
    return joined.withColumn("level", level).where("action is null or action <> 'suppress'")


def level_counts(review: DataFrame, key: str) -> DataFrame:
    return review.groupBy(key).agg(*(F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("block", "warn", "info")))


def blocking_gate(entities: DataFrame, review: DataFrame) -> DataFrame:
    """Entities without an open block."""
    return entities.join(review.where("level = 'block'").select("entity_id").distinct(), "entity_id", "left_anti")


def latest_events(events: DataFrame, n: int = 500) -> DataFrame:
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def event_counts(events: DataFrame, by: str) -> DataFrame:
    return events.groupBy(by).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))


def newest_wins(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or update: of all rows of a key the one of highest order stays."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return current.unionByName(incoming).withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def versioned_update(current: DataFrame, updates: DataFrame) -> DataFrame:
    """(id, ord, status, version): updates (id, ord, base_version) applied one after another to ``current`` (id, version).

    An update is accepted on a null base version or one equal to the version at its turn, and raises the version by one;
    otherwise it conflicts, or finds no row. Updates of an id follow each other, so each task goes through sorted rows and
    holds one version.
    """
    given = updates.select("id", "ord", "base_version").join(current.select("id", F.col("version").alias("now")), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, version = None, None
        for batch in batches:
            rows = batch.to_pydict()
            status, after = [], []
            for id_, base, now in zip(rows["id"], rows["base_version"], rows["now"], strict=True):
                if (id_,) != last:
                    last, version = (id_,), now
                if version is None:
                    status.append("not found")
                elif base is None or base == version:
                    version += 1
                    status.append("accepted")
                else:
                    status.append("conflict")
                after.append(version)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(status, pa.string()), pa.array(after, pa.int64())], names=["id", "ord", "status", "version"])

    dealt = given.repartition("id").sortWithinPartitions("id", "ord", F.col("base_version").asc_nulls_first()).select("id", "ord", F.col("base_version").cast("long"), F.col("now").cast("long"))
    schema = type(dealt.schema)([dealt.schema["id"], dealt.schema["ord"]]).add("status", "string").add("version", "long")
    return dealt.mapInArrow(run, schema)


def usage_quota(events: DataFrame, limit: int) -> DataFrame:
    """Use a day against a limit, capped at 1."""
    used = events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0))).withColumn("ratio", F.least(F.lit(1.0), F.col("used") / limit))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Signed sums, counts and cash paid a counterparty."""
    kind = F.lower("details")
    return ledger.groupBy("entity_id").agg(
        F.count_if(kind == "invoice").alias("n_invoices"),
        F.count_if(kind == "credit note").alias("n_credits"),
        F.round(F.sum(F.when(kind == "invoice", F.col("source")).when(kind == "credit note", -F.abs("source"))), 2).alias("total"),
        F.round(F.sum(F.when(kind == "cash paid", F.col("source"))), 2).alias("cash_paid"),
    )


def invoice_credit_pairs(ledger: DataFrame) -> DataFrame:
    """(entity_id, reference): references that an entity has both as invoice and as credit note."""
    kind = F.lower("details")
    both = ledger.groupBy("entity_id", "reference").agg(F.bool_or(kind == "invoice").alias("i"), F.bool_or(kind == "credit note").alias("c"))
    return both.where("i and c and reference is not null").select("entity_id", "reference")
