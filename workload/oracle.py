"""SQL for the queries of :mod:`workload.catalog`, written against the rules, not the Spark code.

Every text is plain SQL over the test tables. Common table expressions are kept by name in ``CTES``
and pulled into a query when it mentions them.
"""

from __future__ import annotations

import math
import re

from workload.adapters import VIEWS, duckdb_text

D = "86400000000"
M = "2592000000000"
W = "300000000"

CTES: dict[str, str] = {name: duckdb_text(name) for name in VIEWS}
KEPT: set[str] = set()
SQL: dict[str, str] = {}

def bucket(time: str, width: str) -> str:
    return f"CAST(floor({time} / CAST({width} AS DOUBLE)) AS BIGINT)"


def r6(expression: str, name: str | None = None) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name or expression.split('.')[-1]}"


def r6s(*names: str, prefix: str = "") -> str:
    return ", ".join(r6(prefix + name, name) for name in names)


def with_ctes(text: str) -> str:
    """Prefix ``text`` with the common table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(text)
    if not ordered:
        return text
    body = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in KEPT else ''}({CTES[name]})" for name in ordered
    )
    return f"WITH {body}\n{text}"


# --- shared intermediate results -------------------------------------------------------------

CTES["placed"] = """
SELECT m.cell, m.pdu, u.* FROM instance_usage u JOIN machine_map m ON u.machine_id = m.machine_id"""

CTES["no_alloc"] = """
SELECT * FROM placed WHERE alloc_collection_id IS NULL OR alloc_collection_id = 0"""

CTES["clean_power"] = """
SELECT * FROM power WHERE NOT bad_measurement_data AND NOT bad_production_power_data"""


def _usage_by(source: str, key: str, where: str = "TRUE") -> str:
    return f"""
SELECT cell, pdu, {key}, count(*) AS instance_count,
       count(DISTINCT collection_id) AS collection_count,
       count(DISTINCT machine_id) AS machine_count,
       sum(avg_cpus) AS total_cpu_usage, avg(avg_cpus) AS avg_cpu_usage,
       max(avg_cpus) AS max_cpu_usage
FROM {source} WHERE {where} GROUP BY ALL"""


def _power_by(width: str) -> str:
    return f"""
SELECT cell, pdu, {bucket('time', width)} AS window_index,
       {bucket('time', width)} * {width} AS window_start,
       avg(measured_power_util) AS measured_power_util,
       avg(production_power_util) AS production_power_util
FROM clean_power GROUP BY ALL"""


for _days, _width in (("1d", D), ("3d", f"(3 * {D})"), ("7d", f"(7 * {D})"), ("30d", M)):
    CTES[f"usage_{_days}"] = _usage_by("placed", f"{bucket('start_time', _width)} AS window_index")
    CTES[f"power_{_days}"] = _power_by(_width)

CTES["usage_1d_no_alloc"] = _usage_by("no_alloc", f"{bucket('start_time', D)} AS window_index")
CTES["usage_exact"] = _usage_by(
    "no_alloc", "start_time AS window_start", f"end_time - start_time >= {W}"
)

_COUNTS = ("instance_count", "collection_count", "machine_count")
_CPUS = ("total_cpu_usage", "avg_cpu_usage", "max_cpu_usage")
_POWER = ("measured_power_util", "production_power_util")
_ZEROED = ", ".join(
    [f"COALESCE(u.{c}, 0) AS {c}" for c in _COUNTS]
    + [r6(f"COALESCE(u.{c}, 0)", c) for c in _CPUS]
)


def _training(power: str, usage: str, keys: str, extra: str = "") -> str:
    return f"""SELECT p.window_start, p.cell, p.pdu, {extra} {r6s(*_POWER, prefix='p.')}, {_ZEROED}
FROM {power} p LEFT JOIN {usage} u USING ({keys})"""


# --- sources, projections, filters -----------------------------------------------------------

SQL["power_trace_scope"] = f"""SELECT time, cell, pdu, {r6s(*_POWER)},
bad_measurement_data, bad_production_power_data FROM power
WHERE cell IN ('ASIA', 'EUROPE', 'AFRICA')
  AND pdu IN ('NATION_0', 'NATION_7', 'NATION_12', 'NATION_13')"""

SQL["window_buckets"] = f"""SELECT collection_id, start_time,
{bucket('start_time', W)} AS index_5m, {bucket('start_time', D)} AS index_1d,
{bucket('start_time', M)} * {M} AS start_30d FROM instance_usage"""

SQL["in_window_range"] = f"""SELECT {bucket('start_time', D)} BETWEEN 9500 AND 10500 AS inside,
count(*) AS task_rows, min(start_time) AS first_time FROM instance_usage GROUP BY 1"""

SQL["not_in_alloc"] = """SELECT collection_id, instance_index, machine_id, alloc_collection_id
FROM instance_usage WHERE alloc_collection_id IS NULL OR alloc_collection_id = 0"""

SQL["min_duration"] = f"""SELECT collection_id, instance_index, start_time, end_time
FROM instance_usage WHERE end_time - start_time >= 10 * {D}"""

SQL["drop_bad_power"] = f"""SELECT time, cell, pdu, {r6s(*_POWER)},
bad_measurement_data, bad_production_power_data FROM clean_power"""

SQL["select_machines"] = """SELECT machine_id, pdu, cell FROM machine_map
WHERE cell = 'ASIA' AND pdu IN ('NATION_2', 'NATION_7', 'NATION_12')"""

SQL["machines_of_pdu"] = """SELECT machine_id, pdu FROM machine_map
WHERE pdu = 'NATION_16' ORDER BY machine_id"""

SQL["nested_projection"] = f"""SELECT collection_id, machine_id,
{r6('avg_cpus', 'avg_cpu_usage')}, {r6('max_cpus', 'max_cpu_usage')} FROM instance_usage"""

SQL["zero_defaults"] = """SELECT collection_id, instance_index,
COALESCE(alloc_collection_id, 0) AS alloc_collection_id,
COALESCE(collection_type, 0) AS collection_type FROM instance_usage"""

SQL["first_present"] = """SELECT start_time,
COALESCE(instance_submit_time, collection_submit_time, start_time, 0) AS submit_time_us,
COALESCE(instance_priority, -1) AS priority FROM trace_us"""

SQL["coerce_numeric"] = f"""SELECT o_orderkey,
TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority
         WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) || '.0'
         ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT) AS whole,
round(TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus
         ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE), 6) AS real FROM orders"""

CTES["calendar"] = """
SELECT *, CAST(extract('hour' FROM make_timestamp(window_start)) AS BIGINT) AS hour,
       CAST(extract('isodow' FROM make_timestamp(window_start)) - 1 AS BIGINT) AS day_of_week,
       CAST(extract('hour' FROM make_timestamp(window_start)) * 60
            + extract('minute' FROM make_timestamp(window_start)) AS DOUBLE) AS minute_of_day
FROM series_us"""

_CALENDAR = ", ".join(
    [
        "hour",
        "day_of_week",
        "CAST(day_of_week IN (5, 6) AS BIGINT) AS is_weekend",
        r6("sin(2 * pi() * minute_of_day / 1440)", "hour_sin"),
        r6("cos(2 * pi() * minute_of_day / 1440)", "hour_cos"),
        r6("sin(2 * pi() * day_of_week / 7)", "day_of_week_sin"),
        r6("cos(2 * pi() * day_of_week / 7)", "day_of_week_cos"),
    ]
)
SQL["calendar_features"] = f"SELECT cell, pdu, window_start, {_CALENDAR} FROM calendar"

_RATIOS = ", ".join(
    [
        r6("COALESCE(total_cpu_usage / NULLIF(machine_count, 0), 0)", "cpu_per_machine"),
        r6("COALESCE(total_cpu_usage / NULLIF(instance_count, 0), 0)", "cpu_per_instance"),
        r6("max_cpu_usage - avg_cpu_usage", "cpu_spread"),
    ]
)
SQL["ratio_features"] = f"SELECT cell, pdu, window_start, {_RATIOS} FROM series_us"


def _lagged(label: str) -> str:
    lag = "lag({0}) OVER (PARTITION BY cell, pdu ORDER BY window_start)"
    cpu = lag.format("total_cpu_usage")
    return f"""
SELECT *, {lag.format(label)} AS prev_measured_power_util,
       {lag.format('production_power_util')} AS prev_production_power_util,
       {cpu} AS prev_total_cpu_usage, total_cpu_usage - {cpu} AS delta_total_cpu_usage
FROM calendar"""


CTES["lagged"] = _lagged("measured_power_util")
CTES["lagged_production"] = _lagged("production_power_util")
_LAGS = (
    "prev_measured_power_util",
    "prev_production_power_util",
    "prev_total_cpu_usage",
    "delta_total_cpu_usage",
)
SQL["lag_features"] = f"SELECT cell, pdu, window_start, {r6s(*_LAGS)} FROM lagged"
SQL["lag_features_of_production"] = (
    f"SELECT cell, pdu, window_start, {r6s(*_LAGS)} FROM lagged_production"
)
_FILLED = ", ".join(r6(f"COALESCE({c}, 0)", c) for c in _LAGS)
SQL["fill_numeric"] = f"SELECT cell, pdu, window_start, {_FILLED} FROM lagged"

CTES["features"] = f"""
SELECT * REPLACE ({', '.join(f'COALESCE({c}, 0) AS {c}' for c in _LAGS)}),
       CAST(day_of_week IN (5, 6) AS BIGINT) AS is_weekend,
       row_number() OVER (PARTITION BY cell, pdu ORDER BY window_start) AS rn,
       count(*) OVER (PARTITION BY cell, pdu) AS n
FROM lagged"""

SQL["residual_target"] = f"""SELECT cell, pdu, window_start,
{r6('measured_power_util - prev_measured_power_util', 'measured_power_util_residual')}
FROM features"""

SQL["build_features"] = f"""SELECT cell, pdu, window_start, {r6s(*_POWER)}, {', '.join(_COUNTS)},
{r6s(*_CPUS)}, {_CALENDAR}, {_RATIOS}, {r6s(*_LAGS)}
FROM (SELECT * EXCLUDE (is_weekend) FROM features)"""

SQL["array_length"] = """SELECT collection_id, time, type, dependency_ids AS dependency_count
FROM collection_events"""

CTES["trace_effective"] = """
SELECT * REPLACE (COALESCE(dependency_count, 0) AS dependency_count),
       COALESCE(instance_scheduling_class, collection_scheduling_class, 99)
         AS effective_scheduling_class,
       COALESCE(instance_priority, collection_priority, 0) AS effective_priority,
       COALESCE(preferred_scheduler, 0) AS effective_scheduler,
       COALESCE(collection_type, 0) AS effective_collection_type,
       COALESCE(instance_submit_time, collection_submit_time, start_time) AS submit_time_us,
       COALESCE(instance_start_time, collection_schedule_time, start_time) AS run_start_time_us,
       COALESCE(instance_end_time, collection_end_time, end_time) AS run_end_time_us
FROM trace_us"""

SQL["effective_fields"] = """SELECT start_time, effective_scheduling_class, effective_priority,
effective_scheduler, effective_collection_type, dependency_count FROM trace_effective"""


def _timed(source: str, width: str, rho: str) -> str:
    runtime = f"""CASE WHEN run_end_time_us - run_start_time_us IS NULL THEN NULL
         ELSE greatest(run_end_time_us - run_start_time_us, {width}) END"""
    return f"""
SELECT *, submit_time_us + CAST({rho} AS DOUBLE) * actual_runtime_us AS proxy_deadline_us,
       submit_time_us + CAST({rho} AS DOUBLE) * actual_runtime_us
         - (end_time + actual_runtime_us) AS remaining_slack_us
FROM (SELECT *, {runtime} AS actual_runtime_us FROM {source})"""


def _classified(source: str, max_class: int, batch: bool) -> str:
    candidate = f"""effective_collection_type = 0 AND effective_scheduling_class <= {max_class}
         {'AND effective_scheduler = 1' if batch else ''}"""
    return f"""
SELECT *, is_flex_candidate AND NOT is_critical AS is_deferrable,
       NOT is_flex_candidate AS is_online_like
FROM (SELECT *, {candidate} AS is_flex_candidate,
             {candidate} AND remaining_slack_us <= 0 AS is_critical,
             effective_collection_type = 0 AS is_job,
             effective_scheduler = 1 AS is_batch_scheduler,
             COALESCE(alloc_collection_id, 0) <> 0 AS in_alloc_set
      FROM {source})"""


CTES["trace_timed"] = _timed("trace_effective", W, "1.5")
CTES["trace_timed_3"] = _timed("trace_effective", W, "3")
CTES["trace_states"] = _classified("trace_timed", 1, True)
CTES["trace_states_any"] = _classified("trace_timed_3", 2, False)

_TIMING = """submit_time_us, run_start_time_us, run_end_time_us, actual_runtime_us,
proxy_deadline_us, remaining_slack_us"""
SQL["task_timing"] = f"SELECT start_time, {_TIMING} FROM trace_timed"
SQL["classify_tasks"] = f"""SELECT start_time, end_time, {_TIMING}, effective_scheduling_class,
effective_priority, effective_scheduler, is_job, is_batch_scheduler, in_alloc_set,
is_flex_candidate, is_critical, is_deferrable, is_online_like FROM trace_states"""
SQL["classify_tasks_any_scheduler"] = """SELECT start_time, is_flex_candidate, is_critical,
is_deferrable, is_online_like FROM trace_states_any"""

# --- joins -----------------------------------------------------------------------------------

SQL["usage_on_machines"] = """SELECT cell, pdu, machine_id, collection_id, start_time, end_time
FROM placed"""

SQL["power_with_usage"] = _training(
    "power_3d", "usage_3d", "cell, pdu, window_index", "window_index,"
)
CTES["power_readings"] = "SELECT * EXCLUDE (time), time AS window_start FROM power"
SQL["power_with_usage_exact"] = _training(
    "power_readings", "usage_exact", "cell, pdu, window_start"
)

CTES["max_priority"] = """
SELECT collection_id, instance_index, machine_id, max(priority) AS priority FROM instance_events
WHERE alloc_collection_id IS NULL OR alloc_collection_id = 0 GROUP BY ALL"""
SQL["instance_max_priority"] = "SELECT * FROM max_priority"
SQL["usage_with_priority"] = f"""SELECT u.start_time AS window_start, u.end_time AS window_end,
u.collection_id, u.instance_index, u.machine_id, {r6('u.avg_cpus', 'cpu_usage')}, e.priority
FROM no_alloc u LEFT JOIN max_priority e
  ON u.collection_id = e.collection_id AND u.instance_index = e.instance_index
 AND u.machine_id = e.machine_id
WHERE u.end_time - u.start_time >= {W}"""

SQL["restrict_to_collections"] = """SELECT collection_id, time, type, scheduling_class, priority
FROM collection_events WHERE collection_id IN (SELECT collection_id FROM placed WHERE cell = 'ASIA')"""

CTES["collections"] = """
SELECT collection_id,
       min(CASE WHEN type = 0 THEN time END) AS collection_submit_time,
       min(CASE WHEN type = 3 THEN time END) AS collection_schedule_time,
       min(CASE WHEN type IN (5, 6, 7, 8) THEN time END) AS collection_end_time,
       max(scheduling_class) AS collection_scheduling_class,
       max(collection_type) AS collection_type_event,
       max(priority) AS collection_priority,
       max(scheduler) AS preferred_scheduler,
       max(dependency_ids) AS dependency_count,
       max(vertical_scaling) AS vertical_scaling
FROM collection_events
WHERE collection_id IN (SELECT collection_id FROM placed) GROUP BY collection_id"""

CTES["instances"] = """
SELECT collection_id, instance_index,
       min(CASE WHEN type = 0 THEN time END) AS instance_submit_time,
       min(CASE WHEN type = 1 THEN time END) AS instance_queue_time,
       min(CASE WHEN type = 2 THEN time END) AS instance_enable_time,
       min(CASE WHEN type = 3 THEN time END) AS instance_start_time,
       min(CASE WHEN type IN (4, 5, 6, 7, 8) THEN time END) AS instance_end_time,
       max(scheduling_class) AS instance_scheduling_class,
       max(priority) AS instance_priority
FROM instance_events
WHERE collection_id IN (SELECT collection_id FROM placed)
GROUP BY collection_id, instance_index"""

SQL["collection_lifecycle"] = "SELECT * FROM collections"
SQL["instance_lifecycle"] = "SELECT * FROM instances"
_TWO_CELLS = f"CASE WHEN (time / CAST({D} AS DOUBLE)) % 2 < 1 THEN 'x' ELSE 'y' END AS cell"
CTES["collections_by_cell"] = f"""
SELECT cell, collection_id, min(CASE WHEN type = 0 THEN time END) AS collection_submit_time,
       min(CASE WHEN type IN (5, 6, 7, 8) THEN time END) AS collection_end_time,
       max(priority) AS collection_priority
FROM (SELECT *, {_TWO_CELLS} FROM collection_events) GROUP BY 1, 2"""
CTES["instances_by_cell"] = f"""
SELECT cell, collection_id, instance_index, min(CASE WHEN type = 0 THEN time END) AS instance_submit_time,
       min(CASE WHEN type IN (4, 5, 6, 7, 8) THEN time END) AS instance_end_time,
       max(priority) AS instance_priority
FROM (SELECT *, {_TWO_CELLS} FROM instance_events) GROUP BY 1, 2, 3"""
SQL["lifecycles_by_cell"] = """
SELECT i.*, collection_submit_time, collection_end_time, collection_priority
FROM instances_by_cell i LEFT JOIN collections_by_cell c
  ON i.cell = c.cell AND i.collection_id = c.collection_id"""

SQL["task_trace"] = f"""SELECT {bucket('u.start_time', D)} * {D} AS window_start,
{bucket('u.start_time', D)} AS window_index, u.cell, u.pdu, u.start_time, u.end_time,
u.collection_id, u.instance_index, u.machine_id, u.alloc_collection_id, u.alloc_instance_index,
COALESCE(u.collection_type, c.collection_type_event) AS collection_type,
c.collection_submit_time, c.collection_schedule_time, c.collection_end_time,
c.collection_scheduling_class, c.collection_priority, c.preferred_scheduler, c.dependency_count,
c.vertical_scaling, i.instance_submit_time, i.instance_queue_time, i.instance_enable_time,
i.instance_start_time, i.instance_end_time, i.instance_scheduling_class, i.instance_priority,
{r6('u.avg_cpus', 'avg_cpu_usage')}, {r6('u.max_cpus', 'max_cpu_usage')},
{r6s('assigned_memory', 'page_cache_memory', 'cycles_per_instruction',
     'memory_accesses_per_instruction', 'sample_rate', prefix='u.')},
{r6s(*_POWER, prefix='p.')}
FROM placed u
LEFT JOIN collections c ON u.collection_id = c.collection_id
LEFT JOIN instances i ON u.collection_id = i.collection_id AND u.instance_index = i.instance_index
LEFT JOIN power_1d p ON u.cell = p.cell AND u.pdu = p.pdu
  AND {bucket('u.start_time', D)} = p.window_index"""

SQL["task_trace_scope"] = f"""SELECT * FROM ({SQL['task_trace']})
WHERE cell = 'ASIA' AND pdu IN ('NATION_8', 'NATION_9', 'NATION_12', 'NATION_18')
  AND window_index BETWEEN 8300 AND 9300"""

CTES["states_30d"] = f"""
SELECT u.cell, u.pdu, {bucket('u.start_time', M)} AS window_index,
       {bucket('u.start_time', M)} * {M} AS window_start,
       u.collection_id, u.instance_index, u.machine_id, u.alloc_collection_id, u.end_time,
       u.avg_cpus AS avg_cpu_usage,
       COALESCE(i.instance_scheduling_class, c.collection_scheduling_class, 99)
         AS effective_scheduling_class,
       COALESCE(i.instance_priority, c.collection_priority, 0) AS effective_priority,
       COALESCE(c.preferred_scheduler, 0) AS effective_scheduler,
       COALESCE(c.dependency_count, 0) AS dependency_count,
       COALESCE(u.collection_type, c.collection_type_event, 0) AS effective_collection_type,
       COALESCE(i.instance_submit_time, c.collection_submit_time, u.start_time) AS submit_time_us,
       COALESCE(i.instance_start_time, c.collection_schedule_time, u.start_time)
         AS run_start_time_us,
       COALESCE(i.instance_end_time, c.collection_end_time, u.end_time) AS run_end_time_us
FROM placed u
LEFT JOIN collections c ON u.collection_id = c.collection_id
LEFT JOIN instances i ON u.collection_id = i.collection_id AND u.instance_index = i.instance_index"""
CTES["timed_30d"] = _timed("states_30d", W, "1.5")
CTES["timed_30d_any"] = _timed("states_30d", W, "2.5")
CTES["classified_30d"] = _classified("timed_30d", 1, True)
CTES["classified_30d_any"] = _classified("timed_30d_any", 1, False)

SQL["task_states"] = f"""SELECT cell, pdu, window_index, collection_id, instance_index, machine_id,
{r6('avg_cpu_usage')}, effective_scheduling_class, effective_priority, effective_scheduler,
dependency_count, effective_collection_type, submit_time_us, run_start_time_us, run_end_time_us,
actual_runtime_us FROM timed_30d"""


def _flex(source: str, slack_default: str = "NULL", power: str = "") -> str:
    def cpu(flag: str) -> str:
        return f"sum(CASE WHEN {flag} THEN avg_cpu_usage ELSE 0 END)"

    def share(flag: str) -> str:
        return f"""CASE WHEN sum(avg_cpu_usage) > 0 THEN {cpu(flag)} / sum(avg_cpu_usage)
            ELSE 0 END"""

    return f"""
SELECT window_start, window_index, cell, pdu, count(*) AS task_count,
       count(DISTINCT collection_id) AS job_count, count(DISTINCT machine_id) AS machine_count,
       sum(avg_cpu_usage) AS total_cpu_usage,
       {cpu('is_online_like')} AS online_cpu_usage, {cpu('is_deferrable')} AS flex_cpu_usage,
       {cpu('is_critical')} AS critical_cpu_usage,
       {cpu('is_flex_candidate')} AS batch_candidate_cpu_usage,
       count(*) FILTER (is_online_like) AS online_task_count,
       count(*) FILTER (is_deferrable) AS deferrable_task_count,
       count(*) FILTER (is_critical) AS critical_task_count,
       COALESCE(avg(remaining_slack_us) FILTER (is_deferrable), {slack_default})
         AS mean_deferrable_slack_us,
       max(dependency_count) AS max_dependency_count,
       avg(effective_priority) AS mean_priority,
       avg(effective_scheduling_class) AS mean_scheduling_class,
       {share('is_deferrable')} AS flex_cpu_ratio, {share('is_critical')} AS critical_cpu_ratio,
       {share('is_online_like')} AS online_cpu_ratio {power}
FROM {source} GROUP BY window_start, window_index, cell, pdu"""


_TASK_POWER = """, avg(measured_power_util) AS measured_power_util,
       avg(production_power_util) AS production_power_util"""
CTES["flex_30d"] = _flex("classified_30d")
CTES["flex_30d_any"] = _flex("classified_30d_any", "0")
CTES["flex_trace"] = _flex("trace_states", "NULL", _TASK_POWER)
CTES["flex_trace_zero"] = _flex("trace_states", "0", _TASK_POWER)

_FLEX_WHOLE = """task_count, job_count, machine_count, online_task_count, deferrable_task_count,
critical_task_count, max_dependency_count, mean_deferrable_slack_us"""
_FLEX_REAL = (
    "total_cpu_usage",
    "online_cpu_usage",
    "flex_cpu_usage",
    "critical_cpu_usage",
    "batch_candidate_cpu_usage",
    "mean_priority",
    "mean_scheduling_class",
    "flex_cpu_ratio",
    "critical_cpu_ratio",
    "online_cpu_ratio",
)
_FLEX_OUT = f"window_start, window_index, cell, pdu, {_FLEX_WHOLE}, {r6s(*_FLEX_REAL)}"
for _name, _table in (("flex_windows", "flex_30d"), ("flex_windows_any_scheduler", "flex_30d_any")):
    SQL[_name] = f"""SELECT {_FLEX_OUT}, {r6s(*_POWER)}
FROM {_table} LEFT JOIN power_30d USING (window_start, window_index, cell, pdu)"""
SQL["flex_windows_from_trace"] = f"SELECT {_FLEX_OUT}, {r6s(*_POWER)} FROM flex_trace_zero"

SQL["flex_with_power"] = f"""SELECT f.window_start, f.cell, f.pdu, f.task_count,
{r6('f.flex_cpu_ratio')}, {r6s(*_POWER, prefix='s.')}
FROM flex_trace f LEFT JOIN series_us s
  ON f.cell = s.cell AND f.pdu = s.pdu AND f.window_start = s.window_start"""

_COLLIDING = ("total_cpu_usage",) + _POWER
SQL["join_flex_features"] = f"""SELECT s.window_start, s.cell, s.pdu, {r6s(*_POWER, prefix='s.')},
{', '.join('s.' + c for c in _COUNTS)}, {r6s(*_CPUS, prefix='s.')}, f.window_index,
f.task_count, f.job_count, f.machine_count AS flex_window_machine_count, f.online_task_count,
f.deferrable_task_count, f.critical_task_count, f.max_dependency_count, f.mean_deferrable_slack_us,
{', '.join(r6('f.' + c, 'flex_window_' + c) for c in _COLLIDING)},
{', '.join(r6('f.' + c) for c in _FLEX_REAL if c not in _COLLIDING)}
FROM series_us s LEFT JOIN flex_trace f
  ON s.window_start = f.window_start AND s.cell = f.cell AND s.pdu = f.pdu"""


def _covered(days: str) -> str:
    return f"""
SELECT p.cell, p.pdu, p.window_index, u.window_index IS NOT NULL AS matched
FROM power_{days} p LEFT JOIN usage_{days} u
  ON p.cell = u.cell AND p.pdu = u.pdu AND p.window_index = u.window_index"""


for _days in ("1d", "3d", "7d"):
    CTES[f"covered_{_days}"] = _covered(_days)
SQL["coverage_join"] = "SELECT * FROM covered_1d"

# --- aggregations ----------------------------------------------------------------------------

SQL["usage_rollup"] = f"""SELECT cell, pdu, window_index, {', '.join(_COUNTS)}, {r6s(*_CPUS)}
FROM usage_1d"""
SQL["usage_rollup_from_parts"] = f"""SELECT cell, pdu, window_index, {', '.join(_COUNTS)}, {r6s(*_CPUS)}
FROM usage_7d"""
SQL["usage_rollup_exact"] = f"""SELECT cell, pdu, window_start, {', '.join(_COUNTS)}, {r6s(*_CPUS)}
FROM usage_exact"""
SQL["power_rollup"] = f"""SELECT cell, pdu, window_index, window_start, {r6s(*_POWER)}
FROM power_1d"""
SQL["pdu_training_table"] = _training("power_1d", "usage_1d", "cell, pdu, window_index")
SQL["pdu_training_table_no_alloc"] = _training(
    "power_1d", "usage_1d_no_alloc", "cell, pdu, window_index"
)
SQL["pdu_training_table_exact"] = SQL["power_with_usage_exact"]
SQL["ordered_export"] = (
    _training("power_7d", "usage_7d", "cell, pdu, window_index")
    + " ORDER BY p.cell, p.pdu, p.window_start"
)
SQL["distinct_keys"] = "SELECT DISTINCT cell, pdu, collection_id FROM placed"

SQL["power_range"] = f"""SELECT count(*) AS row_count, min(time) AS min_time, max(time) AS max_time,
{', '.join(r6(f'{f}({c})', f'{f}_{c}') for c in _POWER for f in ('min', 'max'))} FROM power"""

SQL["join_coverage"] = f"""SELECT count(*) AS total_power_windows,
count(u.window_start) AS matched_windows, count(*) - count(u.window_start) AS unmatched_windows,
{r6('count(u.window_start) / NULLIF(count(*), 0)', 'matched_ratio')}
FROM power_readings p LEFT JOIN (
  SELECT DISTINCT cell, pdu, start_time AS window_start FROM no_alloc
  WHERE end_time - start_time >= {W}) u USING (cell, pdu, window_start)"""


def _coverage(days: str) -> str:
    return f"""
SELECT cell, pdu, count(*) AS power_windows, count(*) FILTER (matched) AS matched_usage_windows,
       count(*) FILTER (NOT matched) AS unmatched_usage_windows,
       count(*) FILTER (matched) / CAST(count(*) AS DOUBLE) AS matched_ratio
FROM covered_{days} GROUP BY cell, pdu"""


CTES["coverage_3d"] = _coverage("3d")
CTES["coverage_7d"] = _coverage("7d")
_COVERAGE = f"""cell, pdu, power_windows, matched_usage_windows, unmatched_usage_windows,
{r6('matched_ratio')}"""
SQL["join_coverage_by_pdu"] = f"SELECT {_COVERAGE} FROM coverage_3d ORDER BY cell, pdu"
SQL["rank_pdu_candidates"] = f"""SELECT {_COVERAGE},
CASE WHEN matched_ratio >= 0.98 AND matched_usage_windows >= 300 THEN 'strong_dev_candidate'
     WHEN matched_ratio >= 0.95 AND matched_usage_windows >= 200 THEN 'usable_dev_candidate'
     WHEN matched_ratio >= 0.90 AND matched_usage_windows >= 150 THEN 'holdout_or_backup_candidate'
     ELSE 'drop_for_now' END AS recommendation
FROM coverage_7d"""

SQL["quality_summary"] = f"""SELECT count(*) AS row_count,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT cell, pdu, window_start FROM lagged))
  AS duplicate_rows,
{r6('min(prev_measured_power_util)', 'min_label')},
{r6('max(prev_measured_power_util)', 'max_label')},
count(*) FILTER (cell IS NULL) AS null_cells, count(*) FILTER (pdu IS NULL) AS null_pdus,
count(*) FILTER (window_start IS NULL) AS null_windows FROM lagged"""

_TRACE_COLUMNS = ["window_start", "window_index", "cell", "pdu"] + [
    name
    for name in dict.fromkeys(re.findall(r"\bAS (\w+)", VIEWS["trace_us"]))
    if name not in ("BIGINT", "DOUBLE", "window_start")
]
SQL["missing_rates"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name,
{r6(f'count(*) FILTER ({c} IS NULL) / CAST(count(*) AS DOUBLE)', 'missing_rate')} FROM trace_us"""
    for c in _TRACE_COLUMNS
)

SQL["task_state_summary"] = f"""SELECT count(*) AS task_rows,
{r6('avg(CAST(is_flex_candidate AS INTEGER))', 'flex_candidate_ratio')},
{r6('avg(CAST(is_deferrable AS INTEGER))', 'deferrable_ratio')},
{r6('avg(CAST(is_critical AS INTEGER))', 'critical_ratio')},
count(*) FILTER (is_online_like) AS online_like_rows,
count(*) FILTER (is_flex_candidate) AS flex_candidate_rows,
count(*) FILTER (is_deferrable) AS deferrable_rows,
count(*) FILTER (is_critical) AS critical_rows FROM trace_states"""

SQL["scheduling_class_mix"] = """SELECT effective_scheduling_class, count(*) AS task_rows
FROM trace_states GROUP BY 1 ORDER BY 1"""

SQL["flex_dataset_summary"] = f"""SELECT count(*) AS row_count,
(SELECT count(*) FROM (SELECT DISTINCT cell, pdu FROM flex_trace)) AS pdu_count,
min(window_index) AS window_index_min, max(window_index) AS window_index_max,
{', '.join(r6(f'avg({c})', f'mean_{c}') for c in ('task_count', 'total_cpu_usage',
 'flex_cpu_ratio', 'critical_cpu_ratio', 'online_cpu_ratio'))},
{r6('corr(total_cpu_usage, measured_power_util)', 'corr_total_cpu_power')},
{r6('corr(flex_cpu_ratio, measured_power_util)', 'corr_flex_ratio_power')},
{r6('corr(critical_cpu_ratio, measured_power_util)', 'corr_critical_ratio_power')}
FROM flex_trace"""

SQL["flex_ratio_by_pdu"] = f"""SELECT cell, pdu,
{', '.join(r6(f'avg({c})', c) for c in ('flex_cpu_ratio', 'critical_cpu_ratio', 'online_cpu_ratio'))}
FROM flex_trace GROUP BY cell, pdu ORDER BY cell, pdu"""

# --- windows and sequences -------------------------------------------------------------------

CTES["times"] = """
SELECT window_start, row_number() OVER (ORDER BY window_start) - 1 AS k, count(*) OVER () AS n
FROM (SELECT DISTINCT window_start FROM series_us)"""
CTES["cuts"] = """
SELECT n, greatest(1, CAST(floor(n * CAST(0.70 AS DOUBLE)) AS BIGINT)) AS train_end,
       greatest(greatest(1, CAST(floor(n * CAST(0.70 AS DOUBLE)) AS BIGINT)) + 1,
                CAST(floor(n * (CAST(0.70 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS BIGINT)) AS val_end
FROM (SELECT count(*) AS n FROM times)"""
CTES["parts"] = """
SELECT window_start,
       CASE WHEN k < train_end THEN 'train' WHEN k < val_end THEN 'val' ELSE 'test' END AS split
FROM times, cuts"""
CTES["parts"] = CTES["parts"].replace("FROM times, cuts", "FROM times CROSS JOIN cuts")

SQL["split_bounds"] = """SELECT (SELECT n FROM cuts) AS times,
(SELECT min(window_start) FROM parts WHERE split = 'val') AS val_start_us,
(SELECT min(window_start) FROM parts WHERE split = 'test') AS test_start_us"""
SQL["chronological_split"] = f"""SELECT cell, pdu, window_start, {r6('measured_power_util')}, split
FROM series_us JOIN parts USING (window_start)"""
SQL["split_counts"] = """SELECT split, count(*) AS row_count
FROM series_us JOIN parts USING (window_start) GROUP BY split"""

_PAST = "lag({0}, {1}) OVER (PARTITION BY cell, pdu ORDER BY window_start)"


def _past(column: str, step: int) -> str:
    return _PAST.format(column, step)


SQL["sequence_windows"] = f"""SELECT cell, pdu, window_start, {r6('measured_power_util', 'target')},
{', '.join(f'round(cpu_{k:02d}, 6) AS cpu_{k:02d}, round(power_{k:02d}, 6) AS power_{k:02d}'
 for k in range(1, 13))}
FROM (SELECT *, {', '.join(f"{_past('total_cpu_usage', k)} AS cpu_{k:02d}, "
 f"{_past('prev_measured_power_util', k)} AS power_{k:02d}" for k in range(1, 13))} FROM features)
WHERE rn > 12"""

SQL["with_history"] = f"""SELECT cell, pdu, window_start, {r6('measured_power_util', 'target')},
{r6('prev_measured_power_util', 'anchor')}, {r6('oldest', 'oldest_cpu')}, {r6('newest', 'newest_cpu')}
FROM (SELECT *, {_past('total_cpu_usage', 12)} AS oldest, {_past('total_cpu_usage', 1)} AS newest
      FROM features) JOIN parts USING (window_start) WHERE rn > 12 AND split = 'test'"""

SQL["common_rows"] = f"""SELECT cell, pdu, window_start, {r6s('measured_power_util', 'prev_measured_power_util')}
FROM features WHERE rn > 12"""
SQL["sequence_targets"] = f"""SELECT cell, pdu, window_start, {r6('prev_measured_power_util')}
FROM features WHERE rn > 12"""

SQL["flatten_lags"] = f"""SELECT cell, pdu, window_start,
{', '.join(f'round(x{i}, 6) AS x{i}' for i in range(6))}
FROM (SELECT *, {', '.join(f"{_past(c, 3 - s)} AS x{2 * s + i}" for s in range(3)
 for i, c in enumerate(('total_cpu_usage', 'prev_measured_power_util')))} FROM features)
WHERE rn > 3"""

SQL["sample_power_trace"] = f"""SELECT time, cell, pdu, {r6s(*_POWER)} FROM
(SELECT * FROM power ORDER BY time, cell, pdu, measured_power_util, production_power_util LIMIT 288)"""

SQL["union_of_splits"] = """SELECT cell, pdu, window_start, split, split = 'val' AS is_target
FROM series_us JOIN parts USING (window_start) WHERE split <> 'test'"""

# --- models and evaluation -------------------------------------------------------------------

_LEGACY = _COUNTS + _CPUS + (
    "hour",
    "day_of_week",
    "is_weekend",
    "prev_measured_power_util",
    "prev_total_cpu_usage",
)
CTES["train_rows"] = """
SELECT * REPLACE (row_number() OVER (PARTITION BY cell, pdu ORDER BY window_start) AS rn,
                  count(*) OVER (PARTITION BY cell, pdu) AS n)
FROM features JOIN parts USING (window_start) WHERE split = 'train'"""


def _window_rows(source: str, depth: int) -> str:
    """Every context row of every target, one output row per occurrence."""
    return f"""
SELECT c.* FROM {source} t JOIN {source} c ON t.cell = c.cell AND t.pdu = c.pdu
 AND c.rn BETWEEN t.rn - {depth} AND t.rn - 1 WHERE t.rn > {depth}"""


def _std(expression: str) -> str:
    return f"CASE WHEN stddev_pop({expression}) < 1e-6 THEN 1 ELSE stddev_pop({expression}) END"


CTES["train_context"] = _window_rows("train_rows", 12)
SQL["fit_standardizer"] = "\nUNION ALL\n".join(
    [
        f"""SELECT '{c}' AS column_name, 'feature' AS role, {r6(f'avg({c})', 'mean')},
{r6(_std(c), 'std')} FROM train_context"""
        for c in _LEGACY
    ]
    + [
        f"""SELECT 'measured_power_util' AS column_name, 'target' AS role,
{r6('avg(measured_power_util)', 'mean')}, {r6(_std('measured_power_util'), 'std')}
FROM train_rows WHERE rn > 12"""
    ]
)

CTES["context_3"] = _window_rows("features", 3)
CTES["scale_3"] = f"""
SELECT avg(total_cpu_usage) AS cm, {_std('total_cpu_usage')} AS cs,
       avg(prev_measured_power_util) AS pm, {_std('prev_measured_power_util')} AS ps
FROM context_3"""
CTES["scale_y"] = f"""
SELECT avg(measured_power_util) AS ym, {_std('measured_power_util')} AS ys FROM features
WHERE rn > 3"""
SQL["apply_standardizer"] = f"""SELECT cell, pdu, window_start,
{r6('(measured_power_util - ym) / ys', 'target')}, {r6('measured_power_util', 'restored')},
{', '.join(r6(f'(c{k} - cm) / cs', f'cpu_{k:02d}') for k in (1, 2, 3))},
{', '.join(r6(f'(p{k} - pm) / ps', f'power_{k:02d}') for k in (1, 2, 3))}
FROM (SELECT *, {', '.join(f"{_past('total_cpu_usage', k)} AS c{k}, "
 f"{_past('prev_measured_power_util', k)} AS p{k}" for k in (1, 2, 3))} FROM features)
CROSS JOIN scale_3 CROSS JOIN scale_y WHERE rn > 3"""

CTES["line"] = """
SELECT regr_slope(measured_power_util, total_cpu_usage) AS slope,
       regr_intercept(measured_power_util, total_cpu_usage) AS intercept FROM train_rows"""
CTES["scored"] = """
SELECT cell, pdu, window_start, split, measured_power_util AS y, 'persistence' AS model,
       prev_measured_power_util AS prediction
FROM features JOIN parts USING (window_start)
UNION ALL
SELECT cell, pdu, window_start, split, measured_power_util AS y, 'moving_average' AS model,
       (prev_measured_power_util + prev_total_cpu_usage) / 2 AS prediction
FROM features JOIN parts USING (window_start)
UNION ALL
SELECT cell, pdu, window_start, split, measured_power_util AS y, 'cpu_heuristic' AS model,
       intercept + slope * total_cpu_usage AS prediction
FROM features JOIN parts USING (window_start) CROSS JOIN line"""

for _model in ("persistence", "moving_average", "cpu_heuristic"):
    SQL[_model] = f"""SELECT cell, pdu, window_start, split, {r6s('y', 'prediction')}, model
FROM scored WHERE model = '{_model}'"""


def _metrics(keys: str, source: str) -> str:
    return f"""
SELECT {keys}, count(*) AS sample_count, avg(abs(y - prediction)) AS mae,
       sqrt(avg((y - prediction) * (y - prediction))) AS rmse,
       avg(abs((y - prediction) / greatest(abs(y), 1e-8))) AS mape,
       avg(2 * abs(prediction - y) / greatest(abs(y) + abs(prediction), 1e-8)) AS smape,
       CASE WHEN sum((y - ybar) * (y - ybar)) <= 1e-8 THEN 0
            ELSE 1 - sum((y - prediction) * (y - prediction)) / sum((y - ybar) * (y - ybar)) END AS r2
FROM (SELECT *, avg(y) OVER (PARTITION BY {keys}) AS ybar FROM {source}) GROUP BY {keys}"""


_FIVE = ("mae", "rmse", "mape", "smape", "r2")
CTES["by_split"] = _metrics("model, split", "scored")
CTES["seeded"] = """
SELECT *, CAST(substr(pdu, 4, 1) AS BIGINT) AS seed,
       CASE WHEN model = 'cpu_heuristic' THEN 'deep' ELSE 'baseline' END AS family FROM scored"""
CTES["runs"] = _metrics("family, model, seed, split", "seeded")

SQL["regression_metrics"] = f"SELECT model, split, sample_count, {r6s(*_FIVE)} FROM by_split"
SQL["score_simple_models"] = f"""SELECT model, split, sample_count, {r6s(*_FIVE)} FROM by_split
WHERE split IN ('val', 'test')"""
SQL["metrics_long"] = "\nUNION ALL\n".join(
    f"SELECT model, seed, split, '{m}' AS metric, {r6(m, 'value')} FROM runs" for m in _FIVE
)
SQL["run_summary"] = f"""SELECT model, split, count(*) AS runs,
{', '.join(r6(f'avg({m})', f'{m}_mean') + ', ' + r6(f'stddev_pop({m})', f'{m}_std')
 for m in ('mae', 'rmse', 'r2'))} FROM runs GROUP BY model, split"""

CTES["deep_test"] = "SELECT * FROM runs WHERE model = 'cpu_heuristic' AND split = 'test'"
CTES["base_test"] = "SELECT * FROM runs WHERE model = 'persistence' AND split = 'test'"
SQL["runs_by_seed"] = f"""SELECT d.seed, d.model, {r6s('mae', 'rmse', 'r2', prefix='d.')},
b.model AS baseline_model, {', '.join(r6('b.' + m, 'baseline_' + m) for m in ('mae', 'rmse', 'r2'))}
FROM deep_test d JOIN base_test b ON d.seed = b.seed"""
SQL["winner_counts"] = """SELECT count(*) FILTER (d.mae < b.mae) AS mae_wins,
count(*) FILTER (d.rmse < b.rmse) AS rmse_wins, count(*) FILTER (d.r2 > b.r2) AS r2_wins,
count(*) AS seeds FROM deep_test d JOIN base_test b ON d.seed = b.seed"""
SQL["member_metric_mean"] = f"""SELECT model, split, count(*) AS member_count,
{', '.join(r6(f'avg({m})', m) for m in _FIVE)} FROM runs GROUP BY model, split"""
SQL["ensemble_mean"] = f"""SELECT cell, pdu, window_start, split, {r6('max(y)', 'y')},
{r6('avg(prediction)', 'prediction')}, count(*) AS member_count FROM scored
GROUP BY cell, pdu, window_start, split"""

CTES["benchmark"] = f"""
SELECT family, model, seed,
{', '.join(f"max({m}) FILTER (split = '{s}') AS {s}_{m}" for s in ('val', 'test') for m in _FIVE)}
FROM runs WHERE split IN ('val', 'test') GROUP BY family, model, seed"""
_BENCH = r6s(*[f"{s}_{m}" for s in ("val", "test") for m in _FIVE])
SQL["leaderboard"] = f"""SELECT family, model, seed, {_BENCH} FROM benchmark
ORDER BY benchmark.test_mae, benchmark.test_rmse"""
CTES["best_runs"] = """
SELECT * FROM benchmark QUALIFY row_number() OVER
  (PARTITION BY family ORDER BY test_mae, test_rmse, test_r2 DESC) = 1"""
SQL["best_per_family"] = f"SELECT family, model, seed, {_BENCH} FROM best_runs"
SQL["best_gap"] = f"""SELECT d.model AS best_model, b.model AS versus_model,
{', '.join(r6(f'd.test_{m} - b.test_{m}', f'test_{m}_gap') for m in ('mae', 'rmse', 'r2'))}
FROM best_runs d JOIN best_runs b ON d.family = 'deep' AND b.family = 'baseline'"""
SQL["compare_models"] = f"""SELECT family, model, seed, {_BENCH},
CASE WHEN family = 'deep' THEN CAST(12 AS BIGINT) END AS context_length FROM benchmark"""
SQL["stability_table"] = f"""SELECT seed,
{', '.join(r6(f"max({m}) FILTER (model = '{b}' AND split = '{s}')", f'{b}_{s}_{m}')
 for b in ('cpu_heuristic', 'persistence') for s in ('val', 'test') for m in ('mae', 'rmse', 'r2'))}
FROM runs GROUP BY seed ORDER BY seed"""


# --- raw tables to split features ------------------------------------------------------------

CTES["day_table"] = """
SELECT p.*, COALESCE(u.total_cpu_usage, 0) AS cpu, COALESCE(u.machine_count, 0) AS machines
FROM power_1d p LEFT JOIN usage_1d u USING (cell, pdu, window_index)"""
CTES["day_times"] = """
SELECT window_start, row_number() OVER (ORDER BY window_start) - 1 AS k, count(*) OVER () AS n
FROM (SELECT DISTINCT window_start FROM day_table)"""
SQL["training_dataset"] = f"""SELECT d.cell, d.pdu, d.window_start, {r6('d.measured_power_util')},
round(COALESCE(lag(d.measured_power_util) OVER (PARTITION BY d.cell, d.pdu ORDER BY d.window_start),
  0), 6) AS prev_measured_power_util,
{r6('COALESCE(d.cpu / NULLIF(d.machines, 0), 0)', 'cpu_per_machine')},
CASE WHEN k < floor(n * CAST(0.70 AS DOUBLE)) THEN 'train'
     WHEN k < floor(n * (CAST(0.70 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
     ELSE 'test' END AS split
FROM day_table d JOIN day_times t ON d.window_start = t.window_start"""


CTES["split_features"] = "SELECT * FROM features JOIN parts USING (window_start)"

# --- linear models by successive orthogonalization -------------------------------------------
# Centre all columns on the train rows, then subtract from the label and from the later features
# their projection on each feature in turn. What is left of the label is the residual of the least
# squares fit. Ridge is the same fit with one extra row per feature: that feature 1, the rest 0.


def _least_squares(prefix: str, ridge: bool, source: str = "split_features") -> str:
    centred = ", ".join(f"f.{c} - m.m{i} AS x{i}" for i, c in enumerate(_LEGACY))
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(_LEGACY))
    CTES[f"{prefix}_mean"] = f"SELECT avg(measured_power_util) AS my, {means} FROM {source} WHERE split = 'train'"
    rows = f"""
SELECT f.cell, f.pdu, f.window_start, f.split, f.measured_power_util AS y,
       f.split = 'train' AS fitted, f.measured_power_util - m.my AS r, {centred}
FROM {source} f CROSS JOIN {prefix}_mean m"""
    if ridge:
        for i in range(len(_LEGACY)):
            unit = ", ".join("1.0" if k == i else "0.0" for k in range(len(_LEGACY)))
            rows += f"""
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, TRUE, 0.0, {unit}"""
    CTES[f"{prefix}_0"] = rows
    for j in range(len(_LEGACY)):
        later = [f"x{k}" for k in range(j + 1, len(_LEGACY))] + ["r"]
        slopes = ", ".join(
            f"CASE WHEN sum(x{j} * x{j}) > 1e-12 THEN sum(x{j} * {c}) / sum(x{j} * x{j}) ELSE 0 END"
            f" AS b_{c}"
            for c in later
        )
        CTES[f"{prefix}_slope_{j}"] = f"SELECT {slopes} FROM {prefix}_{j} WHERE fitted"
        reduced = ", ".join(f"{c} - b_{c} * x{j} AS {c}" for c in later)
        CTES[f"{prefix}_{j + 1}"] = f"""
SELECT cell, pdu, window_start, split, y, fitted, {reduced}
FROM {prefix}_{j} CROSS JOIN {prefix}_slope_{j}"""
        KEPT.add(f"{prefix}_{j}")
    return f"""SELECT cell, pdu, window_start, split, {r6('y')}, round(y - r, 4) AS prediction,
'{prefix}' AS model FROM {prefix}_{len(_LEGACY)} WHERE cell IS NOT NULL"""


SQL["linear_regression"] = _least_squares("linear_regression", False)
SQL["ridge"] = _least_squares("ridge", True)

# --- least squares on the rows before a row ---------------------------------------------------
# All windows are written out, and normal equations of their standardized numbers are solved by elimination, a column a step.

_DEPTH = 12


def _lagged_fit(prefix: str, rows: str) -> None:
    """``{prefix}_line``: means, deviations and weights of the numbers in a window of ``rows``, for the residual target."""
    numbers = f"[{', '.join(f'CAST({c} AS DOUBLE)' for c in _LEGACY)}]"
    CTES[f"{prefix}_windows"] = f"""
SELECT *, flatten(list({numbers}) OVER (PARTITION BY cell, pdu ORDER BY window_start
  ROWS BETWEEN {_DEPTH} PRECEDING AND 1 PRECEDING)) AS x,
  row_number() OVER (PARTITION BY cell, pdu ORDER BY window_start) AS place FROM {rows}"""
    CTES[f"{prefix}_fitted"] = f"""
SELECT row_number() OVER () AS t, list_append(x, measured_power_util - prev_measured_power_util) AS x
FROM {prefix}_windows WHERE split = 'train' AND place > {_DEPTH}"""
    size = _DEPTH * len(_LEGACY)
    CTES[f"{prefix}_cells"] = f"""
SELECT t, unnest(generate_series(1, {size + 1})) AS i, unnest(x) AS v FROM {prefix}_fitted"""
    CTES[f"{prefix}_scale"] = f"""
SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM {prefix}_cells GROUP BY i"""
    CTES[f"{prefix}_scaled"] = f"""
SELECT t, c.i, CASE WHEN s > 1e-9 THEN (v - m) / s ELSE 0 END AS v FROM {prefix}_cells c JOIN {prefix}_scale s ON c.i = s.i"""
    CTES[f"{prefix}_gram"] = f"""
SELECT a.i, b.i AS j, avg(a.v * b.v) + CASE WHEN a.i = b.i THEN CASE WHEN s > 1e-9 THEN 1e-6 ELSE 1 END ELSE 0 END AS v
FROM {prefix}_scaled a JOIN {prefix}_scaled b ON a.t = b.t JOIN {prefix}_scale s ON a.i = s.i
WHERE a.i <= {size} GROUP BY a.i, b.i, s.s"""
    CTES[f"{prefix}_steps"] = f"""
WITH RECURSIVE steps AS (
  SELECT 1 AS k, list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM {prefix}_gram GROUP BY i)
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
    ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END)
  FROM steps WHERE k <= {size})
SELECT m FROM steps WHERE k = {size + 1}"""
    CTES[f"{prefix}_line"] = f"""
SELECT list(s.m ORDER BY s.i) FILTER (s.i <= {size}) AS means,
  list(CASE WHEN s.s > 1e-9 THEN b.m[s.i][{size + 1}] / s.s ELSE 0 END ORDER BY s.i) FILTER (s.i <= {size}) AS weights,
  max(s.m) FILTER (s.i = {size + 1}) AS target_mean, max(s.s) FILTER (s.i = {size + 1}) AS target_std
FROM {prefix}_scale s CROSS JOIN {prefix}_steps b"""
    KEPT.update(f"{prefix}_{name}" for name in ("windows", "fitted", "scale", "scaled", "gram", "line"))


#: The line's prediction for a row with its window ``x``.
_FROM_LINE = """prev_measured_power_util + target_mean + target_std * list_dot_product(weights, list_transform(x, lambda v, i: v - means[i]))"""

_lagged_fit("lagged", "split_features")
SQL["sequence_regressor"] = f"""SELECT cell, pdu, window_start, split, {r6('measured_power_util', 'y')},
round({_FROM_LINE}, 4) AS prediction
FROM lagged_windows CROSS JOIN lagged_line WHERE split <> 'train' AND place > {_DEPTH}"""

# One cell's own split times; the other cell is unseen.
for _name in ("times", "cuts", "parts"):
    CTES[f"own_{_name}"] = CTES[_name].replace("FROM times", "FROM own_times").replace("JOIN cuts", "JOIN own_cuts").replace(
        "FROM series_us", "FROM series_us WHERE cell = 'c0'"
    )
CTES["own_features"] = """
SELECT f.*, p.split FROM features f JOIN own_parts p ON f.window_start = p.window_start WHERE cell = 'c0'
UNION ALL SELECT *, 'holdout' FROM features WHERE cell = 'c1'"""
_lagged_fit("own_lagged", "own_features")
CTES["holdout_scored"] = f"""
SELECT 'holdout' AS split, measured_power_util AS y, {_FROM_LINE} AS prediction
FROM own_lagged_windows CROSS JOIN own_lagged_line WHERE split = 'holdout' AND place > {_DEPTH}"""
CTES["holdout_metrics"] = _metrics("split", "holdout_scored")
SQL["score_holdout"] = f"SELECT split, sample_count, {r6s(*_FIVE)} FROM holdout_metrics"

# --- random forest, grown a level at a time ---------------------------------------------------
# Bootstrap weights follow from a hash of the row's content, sums are whole numbers, and ties go to the first
# feature and the lowest cut, so that the trees are the same ones.


def _forest(prefix: str, rows: str, trees: int = 200, depth: int = 8, bins: int = 32, seed: int = 42) -> None:
    """``{prefix}_forest``: prediction of every row of ``rows``, by a forest fitted on its train rows."""
    p, prime = prefix, (1 << 31) - 1
    CTES[f"{p}_rows"] = f"SELECT row_number() OVER () AS r, * FROM {rows}"
    CTES[f"{p}_scale"] = f"""
SELECT pow(2.0, 26 - ceil(log2(max(abs(measured_power_util))))) AS k FROM {p}_rows WHERE split = 'train'"""
    fixed = ", ".join(f"CAST(floor(CAST({c} AS DOUBLE) * 65536) AS BIGINT)" for c in ("measured_power_util", *_LEGACY))
    CTES[f"{p}_keyed"] = f"""
SELECT r, CAST(floor(measured_power_util * k + 0.5) AS BIGINT) AS y,
  CAST('0x' || substr(md5(concat_ws('|', {fixed})), 1, 15) AS BIGINT) % {prime} AS key
FROM {p}_rows CROSS JOIN {p}_scale WHERE split = 'train'"""
    numbers = ", ".join(f"CAST({c} AS DOUBLE)" for c in _LEGACY)
    CTES[f"{p}_long"] = f"""
SELECT r, unnest(generate_series(1, {len(_LEGACY)})) AS f, unnest([{numbers}]) AS x FROM {p}_rows"""
    CTES[f"{p}_sample"] = f"SELECT r FROM {p}_keyed QUALIFY row_number() OVER (ORDER BY key) <= 20000"
    CTES[f"{p}_placed"] = f"""
SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS spot, count(*) OVER (PARTITION BY f) AS n,
  dense_rank() OVER (PARTITION BY f ORDER BY x) AS nth FROM {p}_long l JOIN {p}_sample s ON l.r = s.r"""
    CTES[f"{p}_spread"] = f"SELECT *, max(nth) OVER (PARTITION BY f) AS different FROM {p}_placed"
    CTES[f"{p}_cuts"] = f"""
SELECT DISTINCT f, x FROM {p}_spread WHERE CASE WHEN different > {bins}
  THEN list_contains(list_transform(generate_series(1, {bins - 1}), lambda k: k * n // {bins}), spot) ELSE nth < different END"""
    CTES[f"{p}_bins"] = f"""
SELECT l.r, l.f, count(c.x) AS b FROM {p}_long l LEFT JOIN {p}_cuts c ON l.f = c.f AND c.x < l.x GROUP BY l.r, l.f"""
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(1, 9):
        total += term
        steps.append(int(total * prime))
        term /= k
    CTES[f"{p}_trees"] = f"""
SELECT t, 1 + CAST('0x' || substr(md5('{seed}|' || t), 1, 7) AS BIGINT) AS a,
  CAST('0x' || substr(md5('{seed}|' || t), 8, 7) AS BIGINT) AS b FROM generate_series(0, {trees - 1}) g(t)"""
    counted = " + ".join(f"CAST((key * a + b) % {prime} >= {step} AS BIGINT)" for step in steps)
    CTES[f"{p}_in_0"] = f"""
SELECT * FROM (SELECT t, r, y, 1 AS node, {counted} AS w FROM {p}_keyed CROSS JOIN {p}_trees) WHERE w > 0"""
    for level in range(depth + 1):
        CTES[f"{p}_node_{level}"] = f"""
SELECT t, node, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * y) AS BIGINT) AS s FROM {p}_in_{level} GROUP BY t, node"""
        if level == depth:
            break
        CTES[f"{p}_sums_{level}"] = f"""
SELECT i.t, i.node, b.f, b.b, sum(w) AS n, sum(w * y) AS s FROM {p}_in_{level} i JOIN {p}_bins b ON i.r = b.r GROUP BY i.t, i.node, b.f, b.b"""
        CTES[f"{p}_low_{level}"] = f"""
SELECT t, node, f, b, CAST(sum(n) OVER up AS BIGINT) AS ln, CAST(sum(s) OVER up AS BIGINT) AS ls
FROM {p}_sums_{level} WINDOW up AS (PARTITION BY t, node, f ORDER BY b)"""
        CTES[f"{p}_good_{level}"] = f"""
SELECT l.*, n, s, CAST(ls AS DOUBLE) * ls / ln + CAST(s - ls AS DOUBLE) * (s - ls) / (n - ln) AS good
FROM {p}_low_{level} l JOIN {p}_node_{level} o ON l.t = o.t AND l.node = o.node WHERE n > ln"""
        CTES[f"{p}_split_{level}"] = f"""
SELECT t, node, f, b FROM (SELECT * FROM {p}_good_{level}
  QUALIFY row_number() OVER (PARTITION BY t, node ORDER BY good DESC, f, b) = 1)
WHERE good > CAST(s AS DOUBLE) * s / n * {1 + 1e-12!r}"""
        CTES[f"{p}_in_{level + 1}"] = f"""
SELECT i.t, i.r, i.y, 2 * i.node + CAST(b.b > x.b AS INTEGER) AS node, i.w
FROM {p}_in_{level} i JOIN {p}_split_{level} x ON i.t = x.t AND i.node = x.node JOIN {p}_bins b ON i.r = b.r AND x.f = b.f"""
        KEPT.update({f"{p}_in_{level + 1}", f"{p}_split_{level}", f"{p}_node_{level}"})
    CTES[f"{p}_at_0"] = f"SELECT r, t, 1 AS node, TRUE AS open FROM {p}_rows CROSS JOIN {p}_trees"
    for level in range(depth):
        CTES[f"{p}_at_{level + 1}"] = f"""
SELECT a.r, a.t, CASE WHEN x.f IS NULL THEN a.node ELSE 2 * a.node + CAST(b.b > x.b AS INTEGER) END AS node, x.f IS NOT NULL AS open
FROM {p}_at_{level} a LEFT JOIN {p}_split_{level} x ON a.open AND a.t = x.t AND a.node = x.node LEFT JOIN {p}_bins b ON a.r = b.r AND b.f = x.f"""
    CTES[f"{p}_nodes"] = " UNION ALL ".join(f"SELECT * FROM {p}_node_{level}" for level in range(depth + 1))
    CTES[f"{p}_values"] = f"""
SELECT a.r, avg(CAST(s AS DOUBLE) / n / k) AS prediction
FROM {p}_at_{depth} a JOIN {p}_nodes o ON a.t = o.t AND a.node = o.node CROSS JOIN {p}_scale GROUP BY a.r"""
    CTES[f"{p}_forest"] = f"SELECT w.*, v.prediction FROM {p}_rows w JOIN {p}_values v ON w.r = v.r"
    KEPT.update({f"{p}_{name}" for name in ("rows", "keyed", "long", "cuts", "bins", "in_0")} | {f"{p}_node_{depth}"})


_forest("trees", "split_features")
SQL["random_forest"] = f"""SELECT cell, pdu, window_start, split, {r6('measured_power_util', 'y')}, round(prediction, 4) AS prediction,
'random_forest' AS model, 'baseline' AS family, CAST(42 AS BIGINT) AS seed FROM trees_forest"""

# --- all baselines, fitted on one cell ---------------------------------------------------------

_forest("own_trees", "own_features")
for _model, _alpha in (("linear_regression", False), ("ridge", True)):
    _least_squares(f"own_{_model}", _alpha, "own_features")
CTES["own_slope"] = """
SELECT regr_slope(measured_power_util, total_cpu_usage) AS slope,
       regr_intercept(measured_power_util, total_cpu_usage) AS intercept FROM own_features WHERE split = 'train'"""
CTES["own_scored"] = f"""
SELECT 'persistence' AS model, split, measured_power_util AS y, prev_measured_power_util AS prediction FROM own_features
UNION ALL SELECT 'moving_average', split, measured_power_util, (prev_measured_power_util + prev_total_cpu_usage) / 2 FROM own_features
UNION ALL SELECT 'cpu_heuristic', split, measured_power_util, intercept + slope * total_cpu_usage FROM own_features CROSS JOIN own_slope
UNION ALL SELECT 'linear_regression', split, y, y - r FROM own_linear_regression_{len(_LEGACY)} WHERE cell IS NOT NULL
UNION ALL SELECT 'ridge', split, y, y - r FROM own_ridge_{len(_LEGACY)} WHERE cell IS NOT NULL
UNION ALL SELECT 'random_forest', split, measured_power_util, prediction FROM own_trees_forest"""
CTES["own_by_split"] = _metrics("model, split", "own_scored")
SQL["fit_and_score"] = f"""SELECT 'baseline' AS family, model, CAST(42 AS BIGINT) AS seed,
{', '.join(r6(f"max({m}) FILTER (split = '{s}')", f'{s}_{m}') for s in ('val', 'test', 'holdout') for m in _FIVE)}
FROM own_by_split GROUP BY model"""

# --- readers and writers ---------------------------------------------------------------------

SQL["read_frame"] = f"""SELECT window_start, cell, pdu, {r6s(*_POWER)}, {', '.join(_COUNTS)},
{r6s(*_CPUS)} FROM series_us"""
SQL["read_csv_with_preamble"] = f"""SELECT window_start, window_index, cell, pdu, task_count,
{r6('flex_cpu_ratio')} FROM flex_trace"""
SQL["read_power_trace"] = f"""SELECT time, {r6s(*_POWER)}, bad_measurement_data,
bad_production_power_data, cell, pdu FROM power WHERE cell IN ('ASIA', 'AMERICA')
AND pdu IN ('NATION_2', 'NATION_6', 'NATION_12', 'NATION_16')"""
SQL["read_usage"] = f"""SELECT cell, machine_id, start_time, {r6('avg_cpus')} FROM placed
WHERE cell IN ('ASIA', 'EUROPE')"""
SQL["read_collection_events"] = """SELECT collection_id, time, type, priority,
dependency_ids AS deps FROM collection_events"""
SQL["read_instance_events"] = """SELECT time, collection_id, instance_index, machine_id,
alloc_collection_id, type, scheduling_class, priority FROM instance_events"""
SQL["read_machine_map"] = "SELECT machine_id, pdu, cell FROM machine_map"
SQL["named_feature_set"] = f"""SELECT cell, pdu, window_start, {', '.join(_COUNTS)}, {r6s(*_CPUS)},
is_weekend, {r6('sin(2 * pi() * minute_of_day / 1440)', 'hour_sin')},
{r6('cos(2 * pi() * minute_of_day / 1440)', 'hour_cos')},
{r6('sin(2 * pi() * day_of_week / 7)', 'day_of_week_sin')},
{r6('cos(2 * pi() * day_of_week / 7)', 'day_of_week_cos')}, {r6s(*_LAGS)}, {_RATIOS}
FROM features"""
SQL["write_dataset"] = f"""SELECT cell, pdu, window_start, {r6('measured_power_util')},
{r6('prev_measured_power_util')}, split FROM features JOIN parts USING (window_start)"""
SQL["write_dataset_metadata"] = """SELECT 'v1' AS version, 'measured_power_util' AS label,
'chronological' AS split_mode, count(*) AS row_count,
count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
count(*) FILTER (split = 'test') AS test_rows, CAST(25 AS BIGINT) AS column_count
FROM series_us JOIN parts USING (window_start)"""
SQL["write_flex_trace"] = """SELECT 'flex_v1' AS version, CAST(1.5 AS DOUBLE) AS rho,
CAST(1 AS BIGINT) AS max_flex_scheduling_class, (SELECT count(*) FROM trace_us) AS task_rows,
(SELECT count(*) FROM flex_trace) AS window_rows"""
SQL["write_flex_dataset"] = """SELECT count(*) AS row_count,
(SELECT count(*) FROM (SELECT DISTINCT cell, pdu FROM flex_trace)) AS pdu_count,
min(window_index) AS window_index_min, max(window_index) AS window_index_max FROM flex_trace"""
SQL["write_joined_dataset"] = """SELECT s.cell, s.pdu, s.window_start, p.split, f.task_count,
f.machine_count AS flex_window_machine_count FROM series_us s
JOIN parts p ON s.window_start = p.window_start
LEFT JOIN flex_trace f ON s.window_start = f.window_start AND s.cell = f.cell AND s.pdu = f.pdu"""
SQL["write_benchmark"] = f"""SELECT model,
{', '.join(r6(f"max({m}) FILTER (split = '{s}')", f'{s}_{m}') for s, m in (
 ('val', 'mae'), ('val', 'rmse'), ('test', 'mae'), ('test', 'rmse'), ('test', 'r2')))}
FROM by_split GROUP BY model"""
SQL["read_benchmark"] = SQL["leaderboard"].partition("ORDER BY")[0]
SQL["power_rollup_stream"] = f"""SELECT cell, pdu, window_index, {r6s(*_POWER)} FROM power_1d
WHERE (window_index + 1) * {D} <= (SELECT max(time) // 1000 * 1000 - 2 * {D} FROM power
  WHERE NOT bad_measurement_data AND NOT bad_production_power_data)"""
SQL["task_states_from_tables"] = SQL["task_states"]
SQL["ranked_times"] = "SELECT window_start AS time_us, k AS time_rank FROM times"


def oracle() -> dict[str, str]:
    return {name: with_ctes(text) for name, text in SQL.items()}
