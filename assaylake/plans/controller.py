"""Controllers and counters over the event log."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from assaylake.functions import scalars as S
from assaylake.operators import control as O
from assaylake.plans.registry import query
from assaylake.streaming import arrivals


# The arms' priorities and the trend window of the queries below.
PRIORITIES = [0.9, 0.8, 0.7, 0.65]
TREND = O.Limits(history=3)

CLAMPED = "floor(greatest({low}, least({high}, {x})) * 1000000000 + 0.5) / 1000000000"
UNIT = lambda x: CLAMPED.format(low="0.0", high="1.0", x=x)


@query(f"""WITH RECURSIVE flags AS (
  SELECT branch_id, round_index, event_id % 7 = 0 AS split,
         coalesce(structural_collapse_rate > lag(structural_collapse_rate) OVER b + 1e-6, false) AS collapsed,
         count(*) OVER w = 2 AND min(objective_improvement) OVER w > 1e-9 AS sustained,
         count(*) OVER w = 2 AND max(abs(objective_improvement)) OVER w <= 1e-9 AS stagnant
  FROM {{b_scheduler_obs}}
  WINDOW b AS (PARTITION BY branch_id ORDER BY round_index), w AS (PARTITION BY branch_id ORDER BY round_index ROWS 1 PRECEDING)),
moves AS (
  SELECT *, CASE WHEN collapsed THEN 'collapse_increased' WHEN sustained THEN 'sustained_improvement' WHEN stagnant THEN 'stagnation' ELSE 'no_trend' END AS why FROM flags),
fold AS (
  SELECT DISTINCT branch_id, CAST(0 AS BIGINT) AS round_index, CAST(0.5 AS DOUBLE) AS alpha, CAST(1.0 AS DOUBLE) AS temperature,
         CAST(0.2 AS DOUBLE) AS mutation, CAST(0.3 AS DOUBLE) AS diversity, '' AS reasons FROM moves
  UNION ALL
  SELECT m.branch_id, m.round_index,
         {UNIT("f.alpha - CASE WHEN m.why = 'sustained_improvement' THEN 0.1 ELSE 0.0 END")},
         {CLAMPED.format(low="0.01", high="5.0", x="f.temperature + CASE m.why WHEN 'collapse_increased' THEN -0.2 WHEN 'stagnation' THEN 0.2 ELSE 0.0 END")},
         {UNIT("f.mutation + CASE m.why WHEN 'collapse_increased' THEN -0.1 WHEN 'stagnation' THEN 0.1 ELSE 0.0 END")},
         {UNIT("f.diversity + CASE WHEN m.why = 'stagnation' THEN 0.05 ELSE 0.0 END + CASE WHEN m.split THEN 0.05 ELSE 0.0 END")},
         m.why || CASE WHEN m.split THEN ';disagreement' ELSE '' END
  FROM fold f JOIN moves m ON m.branch_id = f.branch_id AND m.round_index = f.round_index + 1)
SELECT branch_id, round_index, alpha, temperature, mutation, diversity, reasons FROM fold WHERE round_index > 0""")
def scheduler_trace(t):
    rows = O.scheduler_trace(t.b_scheduler_obs.withColumn("high_disagreement", F.col("event_id") % 7 == 0))
    return rows.select("branch_id", "round_index", *[S.rounded(F.col(c), 9).alias(c) for c in O.CONTROLS], "reasons")


def _arm(i: int) -> str:
    return f"w{i} + sqrt(CAST(2.0 AS DOUBLE) * ln(CAST(n0 + n1 + n2 + n3 + 2 AS DOUBLE)) / CAST(n{i} + 1 AS DOUBLE))"


FIRST = "CASE " + " ".join(f"WHEN {_arm(i)} >= greatest({', '.join(_arm(k) for k in range(4))}) THEN {i}" for i in range(4)) + " END"
GAINS = "CAST(0.2 AS DOUBLE) * least(1.0, greatest(-1.0, objective_improvement)) AS gain, CAST(0.35 AS DOUBLE) * structural_collapse_rate AS loss, CASE WHEN failed THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS failure"


@query(f"""WITH RECURSIVE seen AS (SELECT branch_id, round_index, event_id % 11 = 0 AS failed, objective_improvement, structural_collapse_rate FROM {{b_scheduler_obs}}),
fold AS (
  SELECT DISTINCT branch_id, CAST(0 AS BIGINT) AS round_index, CAST(NULL AS INTEGER) AS arm, CAST(NULL AS DOUBLE) AS weight,
         {", ".join(f"CAST({p} AS DOUBLE) AS w{i}, CAST(0 AS BIGINT) AS n{i}" for i, p in enumerate(PRIORITIES))} FROM seen
  UNION ALL
  SELECT branch_id, round_index, arm, CASE arm WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END,
         {", ".join(f"v{i}, n{i} + CASE WHEN arm = {i} THEN 1 ELSE 0 END" for i in range(4))}
  FROM (SELECT *, {", ".join(f"CASE WHEN arm = {i} THEN least(1.5, greatest(0.0, w{i} + gain - loss - failure)) ELSE w{i} END AS v{i}" for i in range(4))}
        FROM (SELECT s.branch_id, s.round_index, {GAINS}, {FIRST} AS arm, {", ".join(f"w{i}, n{i}" for i in range(4))}
              FROM fold f JOIN seen s ON s.branch_id = f.branch_id AND s.round_index = f.round_index + 1) a) v)
SELECT branch_id, round_index, arm, floor(weight * 1000000 + 0.5) / 1000000 AS weight FROM fold WHERE round_index > 0""")
def ucb_trace(t):
    rows = t.b_scheduler_obs.withColumn("failed", F.col("event_id") % 11 == 0)
    return O.allocation_trace(rows, "branch_id", PRIORITIES).withColumn("weight", S.rounded(F.col("weight"), 6))


@query()
def stage_allocation(t):
    """Three workers share one allocation state of a bundle; a round is three observations."""
    rows = t.b_scheduler_obs.withColumn("failed", F.col("event_id") % 11 == 0)
    rows = rows.withColumn("worker", F.col("round_index") % 3).withColumn("round_index", F.floor(F.col("round_index") / 3))
    return O.allocation_trace(rows, "branch_id", PRIORITIES, worker="worker").withColumn("weight", S.rounded(F.col("weight"), 6))


@query("""SELECT branch_id, round_index, count(*) OVER w = 3 AND min(objective_improvement) OVER w > 1e-9 AS sustained,
       count(*) OVER w = 3 AND max(abs(objective_improvement)) OVER w <= 1e-9 AS stagnant,
       coalesce(structural_collapse_rate > lag(structural_collapse_rate) OVER b + 1e-6, false) AS collapse_increased,
       lag(structural_collapse_rate) OVER b AS previous_collapse
FROM {b_scheduler_obs} WINDOW w AS (PARTITION BY branch_id ORDER BY round_index ROWS 2 PRECEDING), b AS (PARTITION BY branch_id ORDER BY round_index)""")
def trend_window(t):
    return O.trend(t.b_scheduler_obs, "branch_id", "round_index", "objective_improvement", "structural_collapse_rate", TREND)


@query("""WITH b AS (SELECT branch_id, round_index // 10 AS round, max(objective_improvement) AS best FROM {b_scheduler_obs} GROUP BY 1, 2)
SELECT branch_id, CAST(round AS BIGINT) AS round, CAST(sign(best - lag(best) OVER (PARTITION BY branch_id ORDER BY round)) AS BIGINT) AS improvement FROM b""")
def pareto_cover(t):
    rows = t.b_scheduler_obs.withColumn("round", F.floor(F.col("round_index") / 10))
    return O.cover(rows, ["branch_id"], "round", ["objective_improvement"])


@query("""WITH p AS (SELECT DISTINCT branch_id, round_index // 10 AS round, objective_improvement AS x, -CAST(event_id % 17 AS DOUBLE) AS y FROM {b_scheduler_obs}),
s AS (SELECT branch_id, round, lag(round) OVER (PARTITION BY branch_id ORDER BY round) AS before FROM (SELECT DISTINCT branch_id, round FROM p)),
u AS (SELECT s.branch_id, s.round, bool_and(EXISTS (SELECT 1 FROM p n WHERE n.branch_id = s.branch_id AND n.round = s.round AND n.x >= o.x AND n.y >= o.y)) AS up FROM s JOIN p o ON o.branch_id = s.branch_id AND o.round = s.before GROUP BY 1, 2),
d AS (SELECT s.branch_id, s.round, bool_and(EXISTS (SELECT 1 FROM p o WHERE o.branch_id = s.branch_id AND o.round = s.before AND o.x >= n.x AND o.y >= n.y)) AS down FROM s JOIN p n ON n.branch_id = s.branch_id AND n.round = s.round WHERE s.before IS NOT NULL GROUP BY 1, 2)
SELECT s.branch_id, CAST(s.round AS BIGINT) AS round, CASE WHEN s.before IS NOT NULL THEN CAST(CAST(up AS INTEGER) - CAST(down AS INTEGER) AS BIGINT) END AS improvement FROM s LEFT JOIN u USING (branch_id, round) LEFT JOIN d USING (branch_id, round)""")
def set_improvement(t):
    rows = t.b_scheduler_obs.select("branch_id", F.floor(F.col("round_index") / 10).alias("round"), F.col("objective_improvement").alias("x"), (-(F.col("event_id") % 17)).cast("double").alias("y"))
    return O.cover(rows, ["branch_id"], "round", ["x", "y"])


@query("""SELECT branch_id, CAST(round_index // 20 AS BIGINT) AS round, count(*) AS children, floor(avg(structural_collapse_rate) * 10000 + 0.5) / 10000 AS collapse_rate, floor(sum(objective_improvement) * 100 + 0.5) / 100 AS improvement FROM {b_scheduler_obs} GROUP BY 1, 2""")
def collapse_rate(t):
    rows = t.b_scheduler_obs.groupBy("branch_id", F.floor(F.col("round_index") / 20).alias("round"))
    return rows.agg(F.count("*").alias("children"), S.rounded(F.avg("structural_collapse_rate")).alias("collapse_rate"), S.rounded(F.sum("objective_improvement"), 2).alias("improvement"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY 1, 2""")
def windowed_funnel(t):
    out = t.events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "users")


@query("""SELECT user_id, calls, candidates, calls >= 60 AS exhausted, CASE WHEN failed = calls THEN 'failed' WHEN calls >= 60 THEN 'exhausted' WHEN failed > 10 THEN 'partial' ELSE 'completed' END AS status FROM (SELECT user_id, count(*) AS calls, count(DISTINCT props->>'k') AS candidates, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM {events} GROUP BY 1)""")
def budget_usage(t):
    out = t.events.groupBy("user_id").agg(F.count("*").alias("calls"), F.countDistinct(F.get_json_object("props", "$.k")).alias("candidates"), F.count_if(F.col("event_type") == "error").alias("failed"))
    status = F.when(F.col("failed") == F.col("calls"), "failed").when(F.col("calls") >= 60, "exhausted").when(F.col("failed") > 10, "partial").otherwise("completed")
    return out.select("user_id", "calls", "candidates", (F.col("calls") >= 60).alias("exhausted"), status.alias("status"))


@query("""WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS tier, value FROM {events}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, value DESC, event_id) AS slot FROM p) SELECT user_id, event_id, slot FROM r WHERE slot <= 4""")
def frontier(t):
    from pyspark.sql import Window

    tier = F.when(F.col("event_type") == "error", 0).otherwise(1)
    w = Window.partitionBy("user_id").orderBy(tier, F.desc("value"), "event_id")
    return t.events.withColumn("slot", F.row_number().over(w).cast("long")).where("slot <= 4").select("user_id", "event_id", "slot")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS ends,
  count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_errors FROM s GROUP BY user_id, session""")
def event_sessions(t):
    """Sessions of users; streaming.arrivals.session_counts gives the same on a stream."""
    out = arrivals.session_counts(t.events, "ts", "user_id", "event_type")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", at("begin").alias("begins"), at("end").alias("ends"), "n", "n_errors")


ARRIVED = """a AS (SELECT event_id, ts, user_id || ':' || event_type AS f, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM {events} WHERE event_type <> 'purchase'),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY ts, event_id) AS run FROM a),
h AS (SELECT user_id || ':view' AS f, min(event_id) AS history_id FROM {events} WHERE event_type = 'purchase' AND value > 90 GROUP BY 1)"""


@query(f"""WITH {ARRIVED}, s AS (SELECT event_id, first_value(event_id) OVER (PARTITION BY f, run ORDER BY ts, event_id) AS first_id, history_id FROM r LEFT JOIN h USING (f))
SELECT event_id, first_id, history_id, CASE WHEN history_id IS NOT NULL THEN 'history' WHEN first_id <> event_id THEN 'stream' ELSE 'new' END AS status FROM s""")
def arrival_novelty(t):
    """Events as arrivals: what a user did is new, known from a large purchase's history, or a repeat of the last six hours."""
    arriving = t.events.where("event_type <> 'purchase'").withColumn("f", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    history = t.events.where("event_type = 'purchase' AND value > 90").select(F.concat(F.col("user_id").cast("string"), F.lit(":view")).alias("f"), F.col("event_id").alias("history_id"))
    return arrivals.arrival_novelty(arriving, history, "event_id", "f", "ts", timedelta(hours=6))
