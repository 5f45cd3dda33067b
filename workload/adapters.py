"""Trace-shaped views of the test tables.

One SQL text per view serves both engines; only the conversion of a timestamp to microseconds
(``us``) differs. The views are projections and joins over whole tables.

Money in cents is scaled by an odd divisor: no value then ends exactly half-way at the sixth
decimal place, where the two engines' ``round`` follow different rules.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")
DAY = 86_400_000_000
MONTH = 30 * DAY
WINDOW = 300_000_000

_PLACED_USAGE = """
SELECT us(l_shipdate) AS start_time,
       us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 AS end_time,
       l_orderkey AS collection_id,
       CAST(l_linenumber AS BIGINT) AS instance_index,
       l_suppkey AS machine_id,
       CASE l_returnflag WHEN 'A' THEN CAST(0 AS BIGINT) WHEN 'R' THEN l_partkey END
         AS alloc_collection_id,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS BIGINT) END AS alloc_instance_index,
       CASE WHEN l_linestatus = 'O' THEN CAST(0 AS BIGINT)
            WHEN l_linenumber % 2 = 0 THEN CAST(1 AS BIGINT) END AS collection_type,
       l_extendedprice / CAST(70001 AS DOUBLE) AS avg_cpus,
       l_extendedprice * (1 + l_tax) / CAST(70001 AS DOUBLE) AS max_cpus,
       l_discount AS assigned_memory,
       l_tax AS page_cache_memory,
       l_quantity / CAST(7 AS DOUBLE) AS cycles_per_instruction,
       l_discount / CAST(3 AS DOUBLE) AS memory_accesses_per_instruction,
       CAST(1 AS DOUBLE) AS sample_rate
FROM lineitem
"""

_COLLECTION_FIELDS = """
       o_orderkey AS collection_id,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
            ELSE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 END AS scheduling_class,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END
         AS collection_type,
       o_orderkey % 360 AS priority,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 2 END AS scheduler,
       o_custkey % 3 AS vertical_scaling,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 4 END AS dependency_ids
"""


# (event type, shift of its time in microseconds, rows that have the event)
COLLECTION_KINDS = (
    (0, "0", "o_orderstatus <> 'P'"),
    (3, "86400000000", "o_orderstatus <> 'P'"),
    (4, "2 * 86400000000", "o_orderstatus = 'O'"),
    (5, "(o_orderkey % 17) * 86400000000", "o_orderstatus = 'F' AND o_orderkey % 3 = 0"),
    (6, "(o_orderkey % 40) * 86400000000", "o_orderstatus = 'F'"),
)

_INSTANCE_FIELDS = """
       l_orderkey AS collection_id,
       CAST(l_linenumber AS BIGINT) AS instance_index,
       l_suppkey AS machine_id,
       CASE l_returnflag WHEN 'A' THEN CAST(0 AS BIGINT) WHEN 'R' THEN l_partkey END
         AS alloc_collection_id,
       CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 5 END AS scheduling_class,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey % 200 END AS priority
"""


INSTANCE_KINDS = (
    (0, "-86400000000", "l_returnflag <> 'R'"),
    (1, "-82800000000", "l_linenumber > 0"),
    (2, "-43200000000", "l_linenumber > 0"),
    (3, "0", "l_returnflag <> 'R'"),
    (4, "3 * 86400000000", "l_returnflag = 'A'"),
    (5, "CAST(l_quantity AS BIGINT) * 86400000000", "l_returnflag = 'N'"),
)

EVENT_VIEWS = {
    "collection_events": ("orders", "o_orderdate", _COLLECTION_FIELDS, COLLECTION_KINDS),
    "instance_events": ("lineitem", "l_shipdate", _INSTANCE_FIELDS, INSTANCE_KINDS),
}


def _events_as_union(table: str, time: str, fields: str, kinds) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT us({time}) + {shift} AS time, CAST({kind} AS BIGINT) AS type, {fields} "
        f"FROM {table} WHERE {condition}"
        for kind, shift, condition in kinds
    )


def _events_in_one_scan(table: str, time: str, fields: str, kinds) -> str:
    """The same rows for Spark: the table is read once and each row unfolds into its events."""
    cells = ", ".join(
        f"CASE WHEN {condition} THEN named_struct('time', us({time}) + {shift}, "
        f"'type', CAST({kind} AS BIGINT)) END"
        for kind, shift, condition in kinds
    )
    return f"""SELECT event.time AS time, event.type AS type, * EXCEPT (event) FROM (
SELECT {fields}, explode(array({cells})) AS event FROM {table}) WHERE event IS NOT NULL"""


VIEWS = {
    "machine_map": """
SELECT s_suppkey AS machine_id, n_name AS pdu, r_name AS cell
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "instance_usage": _PLACED_USAGE,
    "collection_events": _events_as_union(*EVENT_VIEWS["collection_events"]),
    "instance_events": _events_as_union(*EVENT_VIEWS["instance_events"]),
    "power": """
SELECT us(o_orderdate) AS time, r_name AS cell, n_name AS pdu,
       o_totalprice / CAST(700001 AS DOUBLE) AS measured_power_util,
       o_totalprice / CAST(900001 AS DOUBLE) AS production_power_util,
       o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS bad_measurement_data,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL
            ELSE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' END AS bad_production_power_data
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "placed_events": """
SELECT CASE WHEN user_id % 5 < 3 THEN 'c0' ELSE 'c1' END AS cell,
       concat('pdu', CAST(user_id % 5 AS VARCHAR(3))) AS pdu,
       CAST(floor(us(ts) / CAST(300000000 AS DOUBLE)) AS BIGINT) AS window_index,
       us(ts) AS time_us, event_id, user_id, event_type, value
FROM events
""",
    "series_us": """
SELECT cell, pdu, window_index * 300000000 AS window_start,
       avg(value * (1 + user_id % 7)) / CAST(97 AS DOUBLE) AS measured_power_util,
       max(value) / CAST(131 AS DOUBLE) AS production_power_util,
       count(*) AS instance_count,
       count(DISTINCT user_id) AS collection_count,
       count(DISTINCT CASE WHEN event_type <> 'view' THEN user_id END) AS machine_count,
       sum(value) / CAST(7 AS DOUBLE) AS total_cpu_usage,
       avg(value) / CAST(7 AS DOUBLE) AS avg_cpu_usage,
       max(value) / CAST(7 AS DOUBLE) AS max_cpu_usage
FROM placed_events GROUP BY cell, pdu, window_index
""",
    "trace_us": """
SELECT window_index * 300000000 AS window_start, window_index, cell, pdu,
       time_us AS start_time,
       time_us + 300000000 + (event_id % 7) * 60000000 AS end_time,
       user_id AS collection_id,
       event_id % 20 AS instance_index,
       event_id % 11 AS machine_id,
       CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN CAST(0 AS BIGINT) END
         AS alloc_collection_id,
       CASE event_id % 6 WHEN 0 THEN CAST(1 AS BIGINT) WHEN 1 THEN NULL ELSE CAST(0 AS BIGINT) END
         AS collection_type,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE time_us - (event_id % 13) * 300000000 END
         AS collection_submit_time,
       time_us - 60000000 AS collection_schedule_time,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE time_us + (event_id % 5) * 600000000 END
         AS collection_end_time,
       CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 4 END AS collection_scheduling_class,
       event_id % 360 AS collection_priority,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 2 END AS preferred_scheduler,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 END AS dependency_count,
       CASE WHEN event_id % 8 < 3 THEN time_us - (event_id % 23) * 300000000 END
         AS instance_submit_time,
       CAST(NULL AS BIGINT) AS instance_queue_time,
       CAST(NULL AS BIGINT) AS instance_enable_time,
       CASE WHEN event_id % 8 < 3 THEN time_us - 30000000 END AS instance_start_time,
       CASE WHEN event_id % 8 < 2 THEN time_us + (event_id % 29) * 300000000 END
         AS instance_end_time,
       CASE WHEN event_id % 9 = 0 THEN event_id % 3 END AS instance_scheduling_class,
       CASE WHEN event_id % 10 = 0 THEN event_id % 100 END AS instance_priority,
       value / CAST(70 AS DOUBLE) AS avg_cpu_usage,
       value / CAST(50 AS DOUBLE) AS max_cpu_usage,
       value / CAST(97 AS DOUBLE) AS measured_power_util,
       value / CAST(131 AS DOUBLE) AS production_power_util
FROM placed_events
""",
}


def duckdb_text(name: str) -> str:
    return re.sub(r"\bus\((\w+)\)", r"epoch_us(\1)", VIEWS[name])


class Trace:
    """The views as Spark frames, built on demand for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = _events_in_one_scan(*EVENT_VIEWS[name]) if name in EVENT_VIEWS else VIEWS[name]
        text = re.sub(r"\bus\((\w+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", text)
        frames = {}
        for source in (*BASE_TABLES, *VIEWS):
            if re.search(rf"\b(FROM|JOIN) {source}\b", text):
                frames[source] = self.table(source) if source in BASE_TABLES else self.view(source)
                text = re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", text)
        return self.spark.sql(text, **frames)

    @property
    def machines(self) -> DataFrame:
        return self.view("machine_map")

    @property
    def power(self) -> DataFrame:
        return self.view("power")

    @property
    def usage(self) -> DataFrame:
        flat = self.view("instance_usage")
        return flat.withColumns(
            {
                "average_usage": F.struct(
                    F.col("avg_cpus").alias("cpus"), F.col("assigned_memory").alias("memory")
                ),
                "maximum_usage": F.struct(
                    F.col("max_cpus").alias("cpus"), F.col("page_cache_memory").alias("memory")
                ),
            }
        ).drop("avg_cpus", "max_cpus")

    @property
    def collection_events(self) -> DataFrame:
        ids = F.when(
            F.col("dependency_ids").isNotNull(), F.sequence(F.lit(1).cast("long"), F.col("dependency_ids"))
        )
        return (
            self.view("collection_events")
            .withColumn("start_after_collection_ids", ids)
            .drop("dependency_ids")
        )

    @property
    def instance_events(self) -> DataFrame:
        return self.view("instance_events")

    @property
    def series(self) -> DataFrame:
        return self.view("series_us").withColumn(
            "window_start", F.timestamp_micros("window_start")
        )

    @property
    def trace(self) -> DataFrame:
        return self.view("trace_us").withColumn("window_start", F.timestamp_micros("window_start"))
