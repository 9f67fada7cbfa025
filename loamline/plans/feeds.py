"""Change feeds run to their end, and the SQL entry, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import watch
from .registry import query
from .sqlgate import guarded


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) > 40")
def sql_gate(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) > 40"
    return guarded(spark, sf, text, ["customer", "nation"], None)


@query(
    """WITH RECURSIVE m AS (SELECT p_partkey AS id, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), w AS (SELECT id, parent, 1 AS depth FROM m WHERE parent = 0 UNION ALL
    SELECT m.id, m.parent, depth + 1 FROM m JOIN w ON m.parent = w.id) SELECT depth, count(*) AS n, max(id) AS last_id FROM w GROUP BY depth"""
)
def sql_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """The whole tree below part 0, which is its own parent and so no row of the recursion."""
    text = """WITH RECURSIVE m AS (SELECT p_partkey AS id, p_partkey div 3 AS parent FROM part WHERE p_partkey > 0), w AS (SELECT id, parent, 1 AS depth FROM m WHERE parent = 0 UNION ALL
    SELECT m.id, m.parent, depth + 1 FROM m JOIN w ON m.parent = w.id) SELECT depth, count(*) AS n, max(id) AS last_id FROM w GROUP BY depth"""
    return guarded(spark, sf, text, ["part"], None)


@query(
    """WITH s AS (SELECT user_id, event_type, event_id AS arrival, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS version, round(value, 3) AS body FROM events),
    m AS (SELECT user_id, event_type, max(version) AS version FROM s GROUP BY 1, 2) SELECT user_id, event_type, version, max_by(body, arrival) AS body FROM s JOIN m USING (user_id, event_type, version) GROUP BY 1, 2, 3"""
)
def late_version(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of statements through state: older versions are ignored however late they come, without a watermark."""
    return watch.newest_versions(spark, f"{sf}/events.parquet")


@query("SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    return watch.counted(spark, f"{sf}/events.parquet")
