"""One conversation holding a third of all messages: bounded work per task, same results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.ordered import add_chunk, lag_within, min_after, row_number_within
from parley.operators.ranking import top_k_per_group
from tests.conftest import rows

ORDER = ["created_at", "position", "message_uuid"]


@pytest.fixture(scope="module")
def skewed(spark):
    """sf0.01 messages; every conversation with id % 3 == 0 merged into one 'hot' conversation."""
    from parley.sources import testdata

    m = testdata.vm_messages(spark, "/root/testdata/sf0.01")
    cid = F.col("conversation_uuid").cast("long")
    hot = cid % 3 == 0
    return m.select(
        F.when(hot, F.lit("hot")).otherwise(F.col("conversation_uuid")).alias("conversation_uuid"),
        "message_uuid", "sender", "created_at",
        F.when(hot, cid * 1000 + F.col("position")).otherwise(F.col("position")).alias("position"))


def test_hot_group_is_a_third(skewed):
    n = skewed.count()
    h = skewed.where(F.col("conversation_uuid") == "hot").count()
    assert 0.3 * n <= h <= 0.4 * n


def test_chunks_bound_rows_per_window_partition(skewed):
    target = 20
    c, hot = add_chunk(skewed, "conversation_uuid", ORDER, target)
    assert hot
    sizes = c.groupBy("conversation_uuid", "_chunk").count()
    assert sizes.agg(F.max("count")).collect()[0][0] <= 3 * target
    assert sizes.where(F.col("conversation_uuid") == "hot").count() > 5


def test_ordered_ops_equal_plain_windows_on_hot_group(skewed):
    w = Window.partitionBy("conversation_uuid").orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    plain = skewed.select("message_uuid", F.lag("created_at").over(w).alias("p"),
                          F.row_number().over(w).cast("long").alias("rn"))
    lag = lag_within(skewed, "conversation_uuid", ORDER, ["created_at"], 20).select(
        "message_uuid", F.col("prev_created_at").alias("p"))
    rn = row_number_within(skewed, "conversation_uuid", ORDER, "rn", 20).select("message_uuid", "rn")
    assert rows(lag.join(rn, "message_uuid")) == rows(plain)
    after = Window.partitionBy("conversation_uuid").orderBy("position", "message_uuid").rowsBetween(
        1, Window.unboundedFollowing)
    v = F.when(F.col("sender") == "human", F.col("position"))
    assert rows(min_after(skewed, "conversation_uuid", ["position", "message_uuid"], {"nh": v}, 20)
                .select("message_uuid", "nh")) == rows(skewed.select("message_uuid", F.min(v).over(after).alias("nh")))


def test_salted_top_k_on_hot_group(skewed):
    order = [F.col("created_at").desc(), F.col("message_uuid").asc()]
    got = top_k_per_group(skewed, ["conversation_uuid"], 3, order, "rank", 20).select("message_uuid", "rank")
    w = Window.partitionBy("conversation_uuid").orderBy(*order)
    plain = skewed.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("message_uuid", "rank")
    assert rows(got) == rows(plain)


def test_chunks_are_bounded_for_ties_clusters_and_nulls(spark):
    """One timestamp for a whole hot group, clustered ones, NULL keys, NULL group: no chunk grows past the target."""
    from pyspark.sql import functions as F

    from parley.operators import ordered

    target = 500
    n = spark.range(8000).select(
        F.when(F.col("id") < 2000, "tied").when(F.col("id") < 4000, "clustered").when(F.col("id") < 6000, "nulls")
        .when(F.col("id") < 7900, F.lit(None)).otherwise("small").alias("g"),
        F.when(F.col("id") < 2000, 7).when(F.col("id") == 2000, 10 ** 12).when(F.col("id") < 4000, F.col("id") % 3)
        .when(F.col("id") < 6000, F.lit(None)).otherwise(F.col("id")).alias("t"), F.col("id"))
    chunked, hot = ordered.add_chunk(n, "g", ["t", "id"], target)
    sizes = {(r.g, r._chunk): r["count"] for r in chunked.groupBy("g", "_chunk").count().collect()}
    assert hot and max(sizes.values()) <= target and sum(sizes.values()) == 8000
    got = ordered.row_number_within(n, "g", ["t", "id"], "rn", target)
    got = ordered.lag_within(got, "g", ["t", "id"], ["id"], target).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (r.t is None, r.t or 0, r.id))
        assert [r.rn for r in rows] == list(range(1, len(rows) + 1))
        assert [r.prev_id for r in rows] == [None] + [r.id for r in rows[:-1]]
