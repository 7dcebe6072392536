"""Registered queries over the driver's tables, with the SQL that must give the same rows.

The sensor logs that the operators are for aren't shipped, so events stand in for them: users are
subjects, event values are readings; a user's day is labelled 1 where its sum exceeds the user's median.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, scalars
from ..functions.constants import AMBIENCE, APPS, PAIRS, PERIODS, ROLLING_MASKS, SHRINK, WINDOWS
from ..operators import calendar, chained, cross_features, folded, folds, history, models, places, priors, rules, scores, selection, stats, trees
from ..sources import sinks

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query and its SQL. Results have dates as text, which every reader shows alike; ``dates`` names the SQL's."""

    def put(f):
        Q[name] = lambda spark, d: _as_text(f(spark, d))
        if sql:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'{c}::DATE::VARCHAR AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return put


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes])


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return stats.keyed(_t(spark, d, "events").select("user_id", "ts", "value", F.length("event_type").alias("kind")), "user_id", "ts").drop("user_id")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_WINDOW_ROWS = _values([(w, h) for w, hours in WINDOWS.items() for h in hours])
_EVENTS = f"""
WITH win AS (SELECT * FROM (VALUES {_WINDOW_ROWS}) t("window", h)),
ev AS (SELECT user_id::VARCHAR AS subject_id, ts::DATE AS lifelog_date, hour(ts) AS h, ts, value, length(event_type) AS kind FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""
_STATS = 'avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median, coalesce(sum(value), 0) AS sum, count(value)::DOUBLE AS count'
_PERIOD = "CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'day' ELSE 'evening' END"


@query("daily_stats", f"""{_EVENTS} SELECT subject_id, lifelog_date, 'value' AS "column", {_STATS} FROM ev GROUP BY ALL""", dates=("lifelog_date",))
def daily_stats(spark, d):
    return stats.daily_stats(_events(spark, d), ["value"])


@query("window_stats", f"""{_EVENTS} SELECT subject_id, lifelog_date, "window", 'value' AS "column", {_STATS}, count(DISTINCT value)::DOUBLE AS nunique FROM ev JOIN win USING (h) GROUP BY ALL""", dates=("lifelog_date",))
def window_stats(spark, d):
    return stats.window_stats(_events(spark, d), ["value"])


@query("period_stats", f"""{_EVENTS} SELECT subject_id, lifelog_date, {_PERIOD} AS period, 'value' AS "column", avg(value) AS mean, coalesce(sum(value), 0) AS sum, count(value)::DOUBLE AS count FROM ev GROUP BY ALL""", dates=("lifelog_date",))
def period_stats(spark, d):
    return stats.period_stats(_events(spark, d), ["value"])


@query("row_counts", f"""{_EVENTS}, days AS (SELECT subject_id, lifelog_date, count(*) AS n FROM ev GROUP BY ALL),
per AS (SELECT subject_id, lifelog_date, {_PERIOD} AS name, count(*) AS n FROM ev GROUP BY ALL)
SELECT subject_id, lifelog_date, 'day' AS scope, '' AS name, n FROM days
UNION ALL SELECT days.subject_id, days.lifelog_date, 'period', p.name, coalesce(per.n, 0) FROM days CROSS JOIN (VALUES {_values([(p,) for p in PERIODS])}) p(name) LEFT JOIN per ON per.subject_id = days.subject_id AND per.lifelog_date = days.lifelog_date AND per.name = p.name
UNION ALL SELECT subject_id, lifelog_date, 'window', "window", count(*) FROM ev JOIN win USING (h) GROUP BY ALL""", dates=("lifelog_date",))
def row_counts(spark, d):
    return stats.row_counts(_events(spark, d))


@query("value_proportions", """
WITH v AS (SELECT l_suppkey::VARCHAR AS subject_id, date_trunc('month', l_shipdate)::DATE AS lifelog_date, unnest([{'c': 'line', 'v': l_linenumber::DOUBLE}, {'c': 'quantity', 'v': l_quantity}]) AS x FROM lineitem),
f AS (SELECT subject_id, lifelog_date, x.c AS "column", x.v AS value FROM v WHERE x.v IS NOT NULL),
gate AS (SELECT "column" FROM f GROUP BY 1 HAVING count(DISTINCT value) <= 12),
obs AS (SELECT DISTINCT "column", value FROM f WHERE "column" IN (SELECT "column" FROM gate)),
tot AS (SELECT subject_id, lifelog_date, "column", count(*) AS a FROM f GROUP BY ALL),
cnt AS (SELECT subject_id, lifelog_date, "column", value, count(*) AS n FROM f GROUP BY ALL)
SELECT subject_id, lifelog_date, "column", value, coalesce(n, 0) / a AS ratio FROM tot JOIN obs USING ("column") LEFT JOIN cnt USING (subject_id, lifelog_date, "column", value)""", dates=("lifelog_date",))
def value_proportions(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("subject_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("lifelog_date"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    return stats.value_proportions(stats.melted(rows, ["line", "quantity"], *stats.KEY), [])


@query("window_proportions", f"""{_EVENTS}, f AS (SELECT subject_id, lifelog_date, "window", 'kind' AS "column", kind::DOUBLE AS value FROM ev JOIN win USING (h)),
obs AS (SELECT DISTINCT "window", value FROM f), gate AS (SELECT "window" FROM obs GROUP BY 1 HAVING count(*) <= 12),
tot AS (SELECT subject_id, lifelog_date, "window", count(*) AS a FROM f GROUP BY ALL), cnt AS (SELECT subject_id, lifelog_date, "window", value, count(*) AS n FROM f GROUP BY ALL)
SELECT subject_id, lifelog_date, "window", 'kind' AS "column", value, coalesce(n, 0) / a AS ratio FROM tot JOIN obs USING ("window") LEFT JOIN cnt USING (subject_id, lifelog_date, "window", value) WHERE "window" IN (SELECT "window" FROM gate)""", dates=("lifelog_date",))
def window_proportions(spark, d):
    return stats.window_proportions(stats.value_counts(_events(spark, d), ["kind"]))


@query("window_interactions", f"""{_EVENTS}, w AS (SELECT subject_id, lifelog_date, "window", sum(value) AS sum, avg(value) AS mean FROM ev JOIN win USING (h) GROUP BY ALL),
s AS (SELECT subject_id, lifelog_date, "window", 'value_sum' AS suffix, sum AS value FROM w UNION ALL SELECT subject_id, lifelog_date, "window", 'value_mean', mean FROM w),
p AS (SELECT * FROM (VALUES {_values(PAIRS)}) t("left", "right")), k AS (SELECT DISTINCT subject_id, lifelog_date, suffix FROM s),
b AS (SELECT k.*, p."left", p."right", l.value AS lv, r.value AS rv FROM k CROSS JOIN p LEFT JOIN s l ON l.subject_id = k.subject_id AND l.lifelog_date = k.lifelog_date AND l.suffix = k.suffix AND l."window" = p."left" LEFT JOIN s r ON r.subject_id = k.subject_id AND r.lifelog_date = k.lifelog_date AND r.suffix = k.suffix AND r."window" = p."right"
 WHERE l.subject_id IS NOT NULL OR r.subject_id IS NOT NULL)
SELECT subject_id, lifelog_date, suffix, "left", "right", rv - lv AS diff, rv / (abs(lv) + 1e-6) AS ratio, abs(rv - lv) AS abs_diff FROM b""", dates=("lifelog_date",))
def window_interactions(spark, d):
    w = sinks.materialised(stats.window_stats(_events(spark, d), ["value"]).select(*stats.KEY, "window", "sum", "mean"))
    each = F.array(*[F.struct(F.lit(f"value_{s}").alias("suffix"), F.col(s).alias("value")) for s in ("sum", "mean")])
    return stats.interactions(w.select(*stats.KEY, "window", F.explode(each).alias("_s")).select(*stats.KEY, "window", "_s.*"))


@query("table_features")
def table_features(spark, d):
    """Every long feature of one table: daily, window, period, counts, proportions and interactions."""
    return stats.table_features(_events(spark, d), "events", ["value", "kind"])


# ---- scalars

@query("scalar_functions", """
SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'day' ELSE 'evening' END AS period, ts::DATE AS date, (ts - INTERVAL 6 HOURS)::DATE AS shifted,
 isodow(ts) - 1 AS dow, 0.5 + 0.25 * (value / 1000 - 0.5) AS shrunk, 0.75 * (value / 1000) + 0.25 * 0.5 AS blended, least(greatest(value / 1000, 0.0001), 0.9999) AS clipped, 1 / (1 + exp(-(value / 100))) AS squashed,
 CASE WHEN value / 1000 >= 0.3 THEN 1 ELSE 0 END AS label, greatest(0.05, value / 1000 - 0.1) AS lowered, trim(regexp_replace(event_type || '--' || event_id || '!', '[^A-Za-z0-9_]+', '_', 'g'), '_') AS safe FROM events""", dates=("date", "shifted"))
def scalar_functions(spark, d):
    p = F.col("value") / 1000
    name = F.concat(F.col("event_type"), F.lit("--"), F.col("event_id").cast("string"), F.lit("!"))
    return _t(spark, d, "events").select(
        "event_id", scalars.time_period("ts").alias("period"), scalars.calendar_date("ts").alias("date"), scalars.shifted_date("ts").alias("shifted"), scalars.weekday("ts").cast("long").alias("dow"),
        scalars.shrink(p, F.lit(0.5), 0.25).alias("shrunk"), scalars.blend(p, F.lit(0.5), 0.75).alias("blended"), scalars.clipped_probability(p).alias("clipped"), scalars.sigmoid(F.col("value") / 100).alias("squashed"),
        scalars.label_at(p, 0.3).alias("label"), scalars.aggressive(p).alias("lowered"), scalars.file_safe(name).alias("safe"),
    )


_STRATEGIES = ["rule_subject_strategy_tuned", "history_blend", "model_extra_trees", "meta_rule_random_forest", "blend_catboost_rule_0.75"]


@query("strategy_names", f"""SELECT r_regionkey, ({_STRATEGIES})[r_regionkey + 1] AS strategy, (['rule', 'history', 'extra_trees', 'random_forest', 'catboost'])[r_regionkey + 1] AS model_name FROM region""")
def strategy_names(spark, d):
    s = F.element_at(F.array(*map(F.lit, _STRATEGIES)), F.col("r_regionkey") + 1)
    return _t(spark, d, "region").select("r_regionkey", s.alias("strategy"), scalars.strategy_model(s).alias("model_name"))


@query("missing_values", "SELECT o_custkey, CASE WHEN o_totalprice > 100000 THEN NULL ELSE o_totalprice END AS x, count(*) AS n, sum(CASE WHEN o_totalprice > 100000 THEN NULL ELSE o_totalprice END) AS s FROM orders GROUP BY ALL")
def missing_values(spark, d):
    x = F.when(F.col("o_totalprice") > 100000, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return scalars.missing_as_null(_t(spark, d, "orders").select("o_custkey", x.alias("x"))).groupBy("o_custkey", "x").agg(F.count("*").alias("n"), F.sum("x").alias("s"))


# ---- nested payloads

_LIST_SQL = """len(v)::DOUBLE AS len, list_avg(v) AS mean, list_stddev_pop(v) AS std, list_min(v) AS min, list_max(v) AS max, list_median(v) AS median, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90,
 list_max(v) - list_min(v) AS range, quantile_cont(x, 0.9) - list_median(v) AS spike, list_median(v) - list_min(v) AS recovery"""


@query("list_stats", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, v, unnest(v) AS x FROM e) SELECT vec_id, {_LIST_SQL} FROM u GROUP BY vec_id, v""")
def list_stats(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", arrays.list_stats(F.col("embedding")).alias("s")).select("vec_id", "s.*")


@query("heart_rate", "SELECT vec_id, list_avg(list_filter(embedding::DOUBLE[], lambda x: x > 0)) AS rate, list_avg(list_filter(embedding::DOUBLE[], lambda x: x > 0)) AS decoded FROM embeddings")
def heart_rate(spark, d):
    text = F.to_json(F.transform("embedding", lambda x: x.cast("double")))
    return _t(spark, d, "embeddings").select("vec_id", arrays.heart_rate(F.col("embedding")).alias("rate"), arrays.heart_rate(text, encoded=True).alias("decoded"))


_SOUNDS = ["Speech", "Silence", "Carnival music", "WINDOW", "White noise", "Television", "Dog", "Snoring in truck", "Rural"]
_LABEL = lambda i: f"({_SOUNDS})[(p_partkey * {i} + p_size) % 9 + 1]"
_AMB_HIT = lambda g: "(" + " OR ".join(f"contains(x.l, '{w}')" for w in AMBIENCE[g]) + ")"
_AMB_LIST = lambda g: f"list_filter(c, lambda x: {_AMB_HIT(g)})"
_TOP_OF = "CASE " + " ".join(f"WHEN {_AMB_HIT(g)} THEN '{g}'" for g in reversed(list(AMBIENCE))) + " END"


@query("ambience", f"""WITH p AS (SELECT p_partkey, [{', '.join("{'l': lower(%s), 's': (p_size * %d %% 17) / 10.0}" % (_LABEL(i), i) for i in (1, 2, 5))}] AS c FROM part),
q AS (SELECT *, greatest(0.0, list_max(list_transform(c, lambda x: x.s))) AS top FROM p),
r AS (SELECT *, list_filter(list_transform(list_filter(c, lambda x: x.s >= top), lambda x: {_TOP_OF}), lambda x: x IS NOT NULL) AS hits FROM q),
z AS (SELECT *, coalesce(hits[-1], 'unknown') AS best FROM r)
SELECT p_partkey, {', '.join(f"coalesce(list_sum(list_transform({_AMB_LIST(g)}, lambda x: x.s)), 0)::DOUBLE AS {g}_score, greatest(0, coalesce(list_max(list_transform({_AMB_LIST(g)}, lambda x: x.s)), 0))::DOUBLE AS {g}_max" for g in AMBIENCE)},
 3.0::DOUBLE AS label_count, top::DOUBLE AS top_score, {', '.join(f"(best = '{g}')::INT::DOUBLE AS top_is_{g}" for g in AMBIENCE)} FROM z""")
def ambience(spark, d):
    part = _t(spark, d, "part")
    label = lambda i: F.get(F.array(*map(F.lit, _SOUNDS)), ((F.col("p_partkey") * i + F.col("p_size")) % 9).cast("int"))
    cell = F.array(*[F.array(label(i), ((F.col("p_size") * i % 17) / 10).cast("string")) for i in (1, 2, 5)])
    return part.select("p_partkey", arrays.ambience(cell).alias("a")).select("p_partkey", "a.*")


_NAMES = ["KakaoTalk 카카오톡", "X", "matrix", "  YouTube ", "Naver Map", "One UI Home", "My Bank", "Camera", "Unknown", "Gmail", "Clash Royal"]
_CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(hay, '{w}')" for w in words) + f" THEN '{c}'" for c, words in APPS.items()) + " ELSE 'other' END"
_USAGE = f"""WITH a AS (SELECT p_partkey, unnest(range(3)) AS i, p_size FROM part),
b AS (SELECT p_partkey, ' ' || lower(trim(({_NAMES})[((p_partkey + i * p_size) % 11 + 1)::INT])) AS hay, (p_size * (i + 1) * 1.5)::DOUBLE AS t FROM a), c AS (SELECT *, {_CATEGORY} AS category FROM b)"""


@query("app_category", f"{_USAGE} SELECT p_partkey, category, count(*) AS n FROM c GROUP BY ALL")
def app_category(spark, d):
    each = _t(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    name = F.get(F.array(*map(F.lit, _NAMES)), ((F.col("p_partkey") + F.col("i") * F.col("p_size")) % 11).cast("int"))
    return each.select("p_partkey", arrays.app_category(name).alias("category")).groupBy("p_partkey", "category").agg(F.count("*").alias("n"))


@query("usage_stats", f"""{_USAGE} SELECT p_partkey, {', '.join(f"coalesce(sum(t) FILTER (category = '{c}'), 0)::DOUBLE AS {c}_time, count(*) FILTER (category = '{c}')::DOUBLE AS {c}_app_count" for c in [*APPS, 'other'])},
 sum(t)::DOUBLE AS total_time, count(*)::DOUBLE AS app_count, max(t) / (sum(t) + 1e-6) AS top_app_time_ratio FROM c GROUP BY p_partkey""")
def usage_stats(spark, d):
    name = lambda i: F.get(F.array(*map(F.lit, _NAMES)), ((F.col("p_partkey") + i * F.col("p_size")) % 11).cast("int"))
    cell = F.array(*[F.struct(name(i).alias("app_name"), (F.col("p_size") * (i + 1) * 1.5).alias("total_time")) for i in range(3)])
    return _t(spark, d, "part").select("p_partkey", arrays.usage(cell).alias("u")).select("p_partkey", "u.*")


@query("gps_features", f"""WITH e AS (SELECT event_id, user_id::VARCHAR AS subject_id, hour(ts) AS h, value + 0.5 AS la, value * 2 + 1 AS lo FROM events), home AS (SELECT subject_id, median(la) AS hx, median(lo) AS hy FROM e WHERE h <= 5 GROUP BY 1)
SELECT event_id, 2.0::DOUBLE AS gps_point_count, la AS gps_latitude_mean, lo AS gps_longitude_mean, 0.5::DOUBLE AS gps_latitude_std, sqrt((la - hx) ** 2 + (lo - hy) ** 2) AS gps_home_distance, sqrt(5.0)::DOUBLE AS gps_mobility_radius FROM e LEFT JOIN home USING (subject_id)""")
def gps_features(spark, d):
    point = lambda o: F.struct((F.col("value") + o).alias("latitude"), (2 * (F.col("value") + o)).alias("longitude"), F.lit(0.0).alias("altitude"), F.lit(None).cast("double").alias("speed"))
    rows = _t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("subject_id"), F.col("ts").alias("timestamp"), F.array(point(0), point(1)).alias("m_gps"))
    out = places.gps_features(rows)
    return out.select("event_id", "gps_point_count", "gps_latitude_mean", "gps_longitude_mean", "gps_latitude_std", "gps_home_distance", "gps_mobility_radius")


_SCANS = "WITH s AS (SELECT l_suppkey::VARCHAR AS subject_id, l_orderkey, (l_partkey % 40)::VARCHAR AS id, -l_quantity * 2 AS rssi FROM lineitem), f AS (SELECT subject_id, id, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 20)"


def _scans(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("subject_id"), "l_orderkey", F.struct((F.col("l_partkey") % 40).cast("string").alias("bssid"), (-F.col("l_quantity") * 2).alias("rssi")).alias("x"))
    return rows.groupBy("subject_id", "l_orderkey").agg(F.collect_list("x").alias("m_wifi"))


@query("frequent_ids", f"{_SCANS} SELECT subject_id, id, n FROM f")
def frequent_ids(spark, d):
    return places.frequent_ids(_scans(spark, d), "subject_id", "m_wifi", "bssid", 20)


@query("network_features", f"""{_SCANS} SELECT subject_id, l_orderkey, count(*)::DOUBLE AS wifi_detected_count, count(DISTINCT id)::DOUBLE AS wifi_unique_count, count(DISTINCT id) FILTER (n IS NOT NULL) / (count(DISTINCT id) + 1e-6) AS wifi_familiar_ratio,
 1 - count(DISTINCT id) FILTER (n IS NOT NULL) / (count(DISTINCT id) + 1e-6) AS wifi_novel_ratio, avg(rssi) AS wifi_rssi_mean, max(rssi) AS wifi_rssi_max, stddev_pop(rssi) AS wifi_rssi_std, count(*) FILTER (rssi >= -65)::DOUBLE AS wifi_strong_count FROM s LEFT JOIN f USING (subject_id, id) GROUP BY ALL""")
def network_features(spark, d):
    return places.wifi_features(_scans(spark, d))


# ---- calendar and model boundary

@query("calendar_features", """SELECT o_orderkey, isodow(o_orderdate) - 1 AS dayofweek, month(o_orderdate) AS month, day(o_orderdate) AS day, 1 AS sleep_gap_days, (o_orderdate::DATE - min(o_orderdate::DATE) OVER (PARTITION BY o_custkey)) AS days_since_start FROM orders""")
def calendar_features(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"), F.to_date("o_orderdate").alias("lifelog_date"), F.date_add(F.to_date("o_orderdate"), 1).alias("sleep_date"))
    names = ["dayofweek", "month", "day", "sleep_gap_days", "days_since_start"]
    return calendar.calendar_features(rows).select("o_orderkey", *[F.col(n).cast("long").alias(n) for n in names])


@query("imputed", """WITH x AS (SELECT o_orderkey, o_orderpriority AS feature, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders), m AS (SELECT feature, median(value) AS md FROM x WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey, feature, coalesce(value, md, 0) AS value FROM x LEFT JOIN m USING (feature)""")
def imputed(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, F.when(k % 10 == 0, F.lit(float("inf"))).otherwise(None)).otherwise(F.col("o_totalprice"))
    rows = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("feature"), value.alias("value"))
    train = rows.withColumn("value", F.when(k % 5 != 0, F.col("value"))).where(k % 2 == 0)
    return calendar.imputed(rows, train).select("o_orderkey", "feature", "value")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", f"""SELECT c_custkey, {', '.join(f"coalesce((c_mktsegment = '{s}')::INT, 0)::DOUBLE AS c_mktsegment_{s}" for s in _SEGMENTS)} FROM customer""")
def one_hot(spark, d):
    return calendar.one_hot(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", _SEGMENTS).drop("c_mktsegment")


@query("label_codes", "SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def label_codes(spark, d):
    return calendar.label_codes(_t(spark, d, "customer"), "c_mktsegment").withColumn("code", F.col("code").cast("long"))


# ---- labels: a user's day is 1 where its sum exceeds the user's median

_LABELS = """WITH day AS (SELECT user_id AS u, ts::DATE AS d, sum(value) AS s FROM events GROUP BY ALL), med AS (SELECT u, median(s) AS m FROM day GROUP BY u),
lab AS (SELECT (u * 1000 + (d - DATE '2024-01-01'))::BIGINT AS row_id, u::VARCHAR AS subject_id, d AS lifelog_date, 'Q1' AS target, (s > m)::INT::DOUBLE AS y FROM day JOIN med USING (u))"""
_FIRST = _LABELS + ", fit AS (SELECT * FROM lab WHERE lifelog_date < DATE '2024-01-20'), pre AS (SELECT row_id, subject_id, lifelog_date, target FROM lab WHERE lifelog_date >= DATE '2024-01-20')"


def _labels(spark, d):
    """The labels, made once, from sums in order of time: two days may have the same decimal sum, and where both are their subject's median
    the order in which doubles are added decides which is over it. The running sum spills, so a day of any size has it."""
    days = Window.partitionBy("user_id", "lifelog_date")
    events = _t(spark, d, "events").where("user_id is not null").select("user_id", "ts", F.to_date("ts").alias("lifelog_date"), "value")
    running = F.sum("value").over(days.orderBy("ts", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.lead(F.lit(1)).over(days.orderBy("ts", "value")).isNull()
    day = events.select("user_id", "lifelog_date", running.alias("s"), last.alias("last")).where("last")
    rows = day.withColumn("m", F.median("s").over(Window.partitionBy("user_id")))
    number = F.col("user_id") * 1000 + F.date_diff("lifelog_date", F.lit("2024-01-01").cast("date"))
    labels = rows.select(number.cast("long").alias("row_id"), F.col("user_id").cast("string").alias("subject_id"), "lifelog_date", F.lit("Q1").alias("target"), (F.col("s") > F.col("m")).cast("double").alias("y"))
    return sinks.materialised(labels)


def _fit_predict(spark, d):
    rows = _labels(spark, d)
    early = F.col("lifelog_date") < F.lit("2024-01-20").cast("date")
    return rows.where(early), rows.where(~early).drop("y")


@query("label_history", f"""{_LABELS}, a AS (SELECT *, isodow(lifelog_date) AS dw, lag(y) OVER w AS last_value FROM lab WINDOW w AS (PARTITION BY subject_id ORDER BY lifelog_date)),
b AS (SELECT *, abs(y - last_value) AS ch, sum(coalesce(abs(y - last_value), 0)) OVER (PARTITION BY subject_id ORDER BY lifelog_date) AS isl FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY subject_id, isl ORDER BY lifelog_date) * CASE WHEN y = 1 THEN 1 ELSE -1 END AS run FROM b)
SELECT row_id, subject_id, lifelog_date, target, y, {', '.join(f"avg(y) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS last_{n}_mean" for n in history.LASTS)}, last_value, coalesce(lag(run) OVER w, 0)::DOUBLE AS streak,
 avg(ch) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS change_rate, avg(y) OVER (PARTITION BY subject_id, dw ORDER BY lifelog_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dow_mean,
 (count(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE AS history_count FROM c WINDOW w AS (PARTITION BY subject_id ORDER BY lifelog_date)""", dates=("lifelog_date",))
def label_history(spark, d):
    return history.label_history(_labels(spark, d))


@query("template_history", f"""{_FIRST}, a AS (SELECT *, isodow(lifelog_date) AS dw, row_number() OVER (PARTITION BY subject_id ORDER BY row_id DESC) AS bk, abs(y - lag(y) OVER (PARTITION BY subject_id ORDER BY row_id)) AS ch FROM fit),
b AS (SELECT *, coalesce(sum(coalesce(ch, 0)) OVER (PARTITION BY subject_id ORDER BY bk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM a),
s AS (SELECT subject_id, {', '.join(f"avg(y) FILTER (bk <= {n}) AS last_{n}_mean" for n in history.LASTS)}, max(y) FILTER (bk = 1) AS last_value, sum(CASE WHEN y = 1 THEN 1 ELSE -1 END) FILTER (later = 0) AS streak, avg(ch) AS change_rate, count(y) AS history_count FROM b GROUP BY 1),
dm AS (SELECT subject_id, dw, avg(y) AS dow_mean FROM a GROUP BY ALL)
SELECT p.row_id, p.subject_id, p.lifelog_date, 'Q1' AS target, {', '.join(f"last_{n}_mean" for n in history.LASTS)}, last_value, coalesce(streak, 0)::DOUBLE AS streak, change_rate, dow_mean, coalesce(history_count, 0)::DOUBLE AS history_count
FROM pre p LEFT JOIN s USING (subject_id) LEFT JOIN dm ON dm.subject_id = p.subject_id AND dm.dw = isodow(p.lifelog_date)""", dates=("lifelog_date",))
def template_history(spark, d):
    fit, ahead = _fit_predict(spark, d)
    return history.template_history(fit, ahead)


_DAYS = "epoch(lifelog_date)::BIGINT // 86400"


@query("temporal_mask", f"""{_LABELS}, c AS (SELECT subject_id, quantile_cont({_DAYS}, 0.75) AS q FROM lab GROUP BY 1) SELECT row_id, {_DAYS} >= q AS is_valid FROM lab JOIN c USING (subject_id)""")
def temporal_mask(spark, d):
    return folds.temporal_mask(_labels(spark, d)).select("row_id", "is_valid")


@query("rolling_masks", f"{_LABELS} " + " UNION ALL ".join(f"SELECT '{n}' AS fold, row_id, {_DAYS} >= q AS is_valid FROM lab JOIN (SELECT subject_id, quantile_cont({_DAYS}, {q!r}) AS q FROM lab GROUP BY 1) USING (subject_id)" for n, q in ROLLING_MASKS.items()))
def rolling_masks(spark, d):
    return folds.rolling_masks(_labels(spark, d)).select("fold", "row_id", "is_valid")


@query("hole_folds", f"{_LABELS}, b AS (SELECT row_id, ntile(10) OVER (PARTITION BY subject_id ORDER BY lifelog_date, row_id) - 1 AS block FROM lab) SELECT row_id, block, block % 5 AS fold FROM b")
def hole_folds(spark, d):
    return folds.hole_folds(_labels(spark, d), 5, order=("lifelog_date", "row_id")).select("row_id", F.col("block").cast("long").alias("block"), F.col("fold").cast("long").alias("fold"))


@query("fold_complement", f"{_LABELS}, b AS (SELECT row_id, ntile(10) OVER (PARTITION BY subject_id ORDER BY lifelog_date, row_id) - 1 AS block FROM lab) SELECT lab.row_id, y FROM lab JOIN b USING (row_id) WHERE block % 5 <> 2")
def fold_complement(spark, d):
    rows = _labels(spark, d)
    held = folds.hole_folds(rows, 5, order=("lifelog_date", "row_id")).where("fold = 2")
    return folds.complement(rows, held).select("row_id", "y")


# ---- priors and rules

@query("group_priors", f"""{_FIRST}, r AS (SELECT *, isodow(lifelog_date) - 1 AS dow FROM fit)
SELECT target, subject_id, dow, avg(y) AS p, count(y) AS n, CASE WHEN subject_id IS NULL AND dow IS NULL THEN 'global' WHEN dow IS NULL THEN 'subject' WHEN subject_id IS NULL THEN 'dow' ELSE 'subject_dow' END AS level FROM r GROUP BY GROUPING SETS ((target), (target, subject_id), (target, dow), (target, subject_id, dow))""")
def group_priors(spark, d):
    return priors.group_priors(_fit_predict(spark, d)[0]).withColumn("dow", F.col("dow").cast("long"))


_PRIORS = f"""{_FIRST}, pr AS (SELECT pre.*, (SELECT avg(y) FROM fit) AS g, s.p AS sp, w.p AS wp, b.p AS bp FROM pre LEFT JOIN (SELECT subject_id, avg(y) AS p FROM fit GROUP BY 1) s USING (subject_id)
 LEFT JOIN (SELECT isodow(lifelog_date) AS dw, avg(y) AS p FROM fit GROUP BY 1) w ON w.dw = isodow(pre.lifelog_date) LEFT JOIN (SELECT subject_id, isodow(lifelog_date) AS dw, avg(y) AS p FROM fit GROUP BY 1, 2) b ON b.subject_id = pre.subject_id AND b.dw = isodow(pre.lifelog_date)),
pp AS (SELECT row_id, subject_id, lifelog_date, target, g AS p_global, coalesce(sp, g) AS p_subject, coalesce(wp, g) AS p_dow, coalesce(bp, sp, g) AS p_subject_dow FROM pr)"""
_VOTE = lambda x: f"({x} >= 0.5)::INT"


@query("prior_probabilities", f"{_PRIORS} SELECT * FROM pp", dates=("lifelog_date",))
def prior_probabilities(spark, d):
    return priors.prior_probabilities(*_fit_predict(spark, d))


_UNPIVOT = lambda named: " UNION ALL ".join(f"SELECT row_id, subject_id, lifelog_date, target, '{n}' AS strategy, {e} AS label FROM pp" for n, e in named.items())


@query("prior_predictions", f"{_PRIORS} " + _UNPIVOT({"global_majority": _VOTE("p_global"), "subject_majority": _VOTE("p_subject"), "subject_dow_majority": _VOTE("p_subject_dow"), "global_dow_majority": _VOTE("p_dow"), **{f"blend_subject_global_{a:g}": _VOTE(f"({a} * p_subject + {1 - a} * p_global)") for a in priors.ALPHAS}}), dates=("lifelog_date",))
def prior_predictions(spark, d):
    return priors.prior_predictions(priors.prior_probabilities(*_fit_predict(spark, d)))


@query("vote_blends", f"{_PRIORS} " + _UNPIVOT({f"blend_subject_global_{a:g}": _VOTE(f"({a} * {_VOTE('p_subject')} + {1 - a} * {_VOTE('p_global')})") for a in priors.ALPHAS}), dates=("lifelog_date",))
def vote_blends(spark, d):
    return priors.vote_blends(priors.prior_probabilities(*_fit_predict(spark, d)))


@query("rolling_majorities", f"""{_FIRST}, t AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY lifelog_date DESC) AS bk FROM fit), s AS (SELECT subject_id, {', '.join(f"avg(y) FILTER (bk <= {n}) AS m{n}" for n in priors.ROLLING)} FROM t GROUP BY 1), j AS (SELECT pre.*, s.* EXCLUDE (subject_id), (SELECT avg(y) FROM fit) AS g FROM pre LEFT JOIN s USING (subject_id))
""" + " UNION ALL ".join(f"SELECT row_id, subject_id, lifelog_date, target, 'rolling_last_{n}' AS strategy, (coalesce(m{n}, g) >= 0.5)::INT AS label FROM j" for n in priors.ROLLING), dates=("lifelog_date",))
def rolling_majorities(spark, d):
    return priors.rolling_majorities(*_fit_predict(spark, d))


_RULE_STATE = f"""{_FIRST}, st AS (SELECT subject_id, list(y ORDER BY lifelog_date) AS t, avg(y) AS m FROM fit GROUP BY 1), dw AS (SELECT subject_id, isodow(lifelog_date) AS w, avg(y) AS dm, arg_max(y, lifelog_date) AS dl FROM fit GROUP BY ALL),
j AS (SELECT pre.*, t, m, dm, dl, len(t) AS n, row_number() OVER (PARTITION BY pre.subject_id ORDER BY row_id) - 1 AS pos FROM pre LEFT JOIN st USING (subject_id) LEFT JOIN dw ON dw.subject_id = pre.subject_id AND dw.w = isodow(pre.lifelog_date))"""
_RULE_SQL = {"all_0": "0", "all_1": "1", "subject_dow_majority": "(coalesce(dm, m) >= 0.5)::INT", "last_same_dow": "coalesce(dl, t[-1])::INT"}
_RULE_SQL |= {f"rolling_last_{k}": f"(list_avg(t[greatest(n - {k}, 0) + 1:]) >= 0.5)::INT" for k in rules.ROLLING}
_RULE_SQL |= {f"cycle_last_{k}": f"((t[greatest(n - {k}, 0) + 1:])[pos % least(n, {k}) + 1])::INT" for k in rules.CYCLES}
_RULE_SQL |= {f"repeat_lag_{k}": f"CASE WHEN n >= {k} THEN t[n - {k} + 1] ELSE t[-1] END::INT" for k in rules.LAGS}


@query("rule_labels", f"{_RULE_STATE} " + " UNION ALL ".join(f"SELECT row_id, '{r}' AS rule, CASE WHEN t IS NULL THEN 1 ELSE {e} END AS label FROM j" for r, e in _RULE_SQL.items()))
def rule_labels(spark, d):
    return rules.rule_labels(*_fit_predict(spark, d)).select("row_id", "rule", "label")


_F1 = "(2 * pr * rc / greatest(pr + rc, 1e-12))"


def _rules_sql(fit: str, predict: str, more: str) -> str:
    """CTEs of all rules' labels (rl) for the rows of one table from those of another, with the columns ``more`` of the former."""
    each = " UNION ALL ".join(f"SELECT row_id, subject_id, {more}'{r}' AS rule, {i} AS ord, CASE WHEN t IS NULL THEN 1 ELSE {e} END AS label FROM jr" for i, (r, e) in enumerate(_RULE_SQL.items()))
    return f"""sr AS (SELECT subject_id, list(y ORDER BY lifelog_date) AS t, avg(y) AS m FROM {fit} GROUP BY 1), dr AS (SELECT subject_id, isodow(lifelog_date) AS w, avg(y) AS dm, arg_max(y, lifelog_date) AS dl FROM {fit} GROUP BY ALL),
jr AS (SELECT p.*, t, m, dm, dl, len(t) AS n, row_number() OVER (PARTITION BY p.subject_id ORDER BY row_id) - 1 AS pos FROM {predict} p LEFT JOIN sr USING (subject_id) LEFT JOIN dr ON dr.subject_id = p.subject_id AND dr.w = isodow(p.lifelog_date)),
rl AS ({each})"""


def _tuned_sql(labels: str) -> str:
    """CTEs of each subject's rule (tr), tuned on its last quarter."""
    return f"""qt AS (SELECT subject_id, quantile_cont({_DAYS}, 0.75) AS q FROM {labels} GROUP BY 1), sp AS (SELECT l.*, {_DAYS} >= q AS v FROM {labels} l JOIN qt USING (subject_id)), fr AS (SELECT * FROM sp WHERE NOT v), vr AS (SELECT * FROM sp WHERE v),
{_rules_sql("fr", "vr", "y, ")},
ct AS (SELECT subject_id, rule, ord, avg((y = label)::INT) AS accuracy, count(*) FILTER (y = 1 AND label = 1) / greatest(count(*) FILTER (label = 1), 1) AS pr, count(*) FILTER (y = 1 AND label = 1) / greatest(count(*) FILTER (y = 1), 1) AS rc FROM rl WHERE subject_id IN (SELECT subject_id FROM fr) GROUP BY ALL),
bt AS (SELECT subject_id, rule, row_number() OVER (PARTITION BY subject_id ORDER BY accuracy DESC, {_F1} DESC, ord) AS k FROM ct),
tr AS (SELECT subject_id, coalesce(rule, '{rules.FALLBACK}') AS rule FROM (SELECT DISTINCT subject_id FROM {labels}) LEFT JOIN (SELECT * FROM bt WHERE k = 1) USING (subject_id))"""




@query("tuned_rules", f"{_LABELS}, {_tuned_sql('lab')} SELECT subject_id, 'Q1' AS target, rule FROM tr")
def tuned_rules(spark, d):
    return rules.tuned_rules(_labels(spark, d))


@query("tuned_predictions", f"""{_FIRST}, trs AS (WITH {_tuned_sql('fit')} SELECT * FROM tr), {_rules_sql("fit", "pre", "")} SELECT row_id, 'Q1' AS target, label FROM rl LEFT JOIN trs USING (subject_id) WHERE rl.rule = coalesce(trs.rule, 'all_1')""")
def tuned_predictions(spark, d):
    return rules.tuned_predictions(*_fit_predict(spark, d)).select("row_id", "target", "label")


# ---- scores and selection: labels.quality against a score from the text's length

_SCORED = """WITH p AS (SELECT l.doc_id, l.quality AS y, d.source, d.lang AS target, 1 / (1 + exp(-(d.n_chars - 1500) / 1000.0)) AS p FROM labels l JOIN documents d USING (doc_id))"""


def _scored(spark, d):
    p = scalars.sigmoid((F.col("n_chars") - 1500) / 1000.0)
    return _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), "source", F.col("lang").alias("target"), p.alias("p"))


def _confusion(keys: str, label: str, frm: str = "p") -> str:
    return f"""c AS (SELECT {keys}, avg((y = ({label})::INT)::INT) AS accuracy, avg(({label})::INT) AS positive_rate, count(*) FILTER (y = 1 AND {label}) / greatest(count(*) FILTER ({label}), 1) AS pr, count(*) FILTER (y = 1 AND {label}) / greatest(count(*) FILTER (y = 1), 1) AS rc, avg(y) AS prior FROM {frm} GROUP BY {keys})"""


_THRESHOLDS = f"{_SCORED}, t AS (SELECT * FROM p CROSS JOIN (VALUES {_values([(x,) for x in selection.THRESHOLDS])}) v(threshold)), {_confusion('target, threshold', 'p >= threshold', 't')}, th AS (SELECT target, threshold::DOUBLE AS threshold, accuracy, {_F1} AS f1, positive_rate, abs(positive_rate - prior) AS prior_gap FROM c)"


@query("binary_scores", f"{_SCORED}, {_confusion('target', 'p >= 0.5')} SELECT target, accuracy, {_F1} AS f1, positive_rate FROM c")
def binary_scores(spark, d):
    return _scored(spark, d).withColumn("label", scalars.label_at("p", 0.5)).groupBy("target").agg(*scores.binary_scores("y", "label"))


@query("log_loss", f"{_SCORED} SELECT target, -avg(y * ln(least(greatest(p, 1e-4), 1 - 1e-4)) + (1 - y) * ln(1 - least(greatest(p, 1e-4), 1 - 1e-4))) AS logloss FROM p GROUP BY 1")
def log_loss(spark, d):
    return _scored(spark, d).groupBy("target").agg(scores.log_loss("y", "p"))


@query("threshold_scores", f"{_THRESHOLDS} SELECT * FROM th")
def threshold_scores(spark, d):
    return selection.threshold_scores(_scored(spark, d), ["target"])


@query("best_thresholds", f"{_THRESHOLDS} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(f1, 12) DESC, round(accuracy, 12) DESC, round(prior_gap, 12), threshold) AS r FROM th) WHERE r = 1")
def best_thresholds(spark, d):
    return selection.best_thresholds(_scored(spark, d), ["target"])


_GRID = f"""{_SCORED}, pr AS (SELECT avg(y) AS prior FROM p), g AS (SELECT p.*, pr.prior, a AS shrink_alpha, least(greatest(prior + a * (p - prior), 1e-4), 1 - 1e-4) AS q FROM p CROSS JOIN pr CROSS JOIN (VALUES {_values([(a,) for a in SHRINK])}) v(a)),
gs AS (SELECT target, source AS fold, 'length' AS submission_strategy, 'length' AS model_name, shrink_alpha::DOUBLE AS shrink_alpha, -avg(y * ln(q) + (1 - y) * ln(1 - q)) AS logloss FROM g GROUP BY ALL),
su AS (SELECT target, submission_strategy, model_name, shrink_alpha, avg(logloss) AS mean_logloss, coalesce(stddev_samp(logloss), 0) AS std_logloss, max(logloss) AS max_logloss, count(DISTINCT fold) AS folds FROM gs GROUP BY ALL),
sc AS (SELECT *, mean_logloss + 0.25 * std_logloss + 0.05 * max_logloss AS selection_score FROM su)"""


def _grid(spark, d):
    rows = _scored(spark, d)
    prior = rows.agg(F.avg("y").alias("prior"))
    # a one-row aggregate on the other side
    named = rows.join(F.broadcast(prior)).withColumns({"fold": F.col("source"), "submission_strategy": F.lit("length"), "model_name": F.lit("length")})
    return selection.shrink_grid(named, ["target", "fold", "submission_strategy", "model_name"])


@query("shrink_grid", f"{_GRID} SELECT * FROM gs")
def shrink_grid(spark, d):
    return _grid(spark, d)


@query("logloss_summary", f"{_GRID} SELECT * FROM sc")
def logloss_summary(spark, d):
    return scores.logloss_summary(_grid(spark, d))


@query("select_logloss", f"{_GRID} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY selection_score, mean_logloss, max_logloss, shrink_alpha) AS r FROM sc) WHERE r = 1")
def select_logloss(spark, d):
    return selection.select_logloss(_grid(spark, d))


@query("registry", f"{_GRID} SELECT * EXCLUDE (r), 'length' AS source FROM (SELECT *, row_number() OVER (PARTITION BY target, submission_strategy ORDER BY selection_score, mean_logloss, max_logloss, shrink_alpha) AS r FROM sc) WHERE r = 1")
def registry(spark, d):
    return selection.registry(_grid(spark, d))


_FOLDED = f"{_SCORED}, {_confusion('target, source', 'p >= 0.5')}, fs AS (SELECT target, source AS fold, accuracy, {_F1} AS f1, positive_rate, abs(positive_rate - prior) AS prior_gap FROM c)"


def _folded(spark, d):
    rows = _scored(spark, d).withColumn("label", scalars.label_at("p", 0.5)).groupBy("target", F.col("source").alias("fold")).agg(*scores.binary_scores("y", "label"), F.avg("y").alias("prior"))
    return rows.select("target", "fold", F.lit("length").alias("submission_strategy"), F.lit("length").alias("model_name"), F.lit("length").alias("strategy"), F.lit(0.5).alias("threshold"), "accuracy", "f1", "positive_rate", F.abs(F.col("positive_rate") - F.col("prior")).alias("prior_gap"), F.col("fold").alias("candidate_ord"))


_GENERAL = f"""{_FOLDED}, gg AS (SELECT target, 'length' AS submission_strategy, 'length' AS model_name, avg(f1) AS mean_f1, coalesce(stddev_samp(f1), 0) AS std_f1, min(f1) AS min_f1, avg(accuracy) AS mean_accuracy, avg(prior_gap) AS mean_prior_gap, 0.5::DOUBLE AS median_threshold, count(DISTINCT fold) AS folds FROM fs GROUP BY target)"""


@query("generalization_summary", f"{_GENERAL} SELECT *, mean_f1 - 0.5 * std_f1 + 0.1 * min_f1 AS generalization_score FROM gg")
def generalization_summary(spark, d):
    return scores.generalization_summary(_folded(spark, d))


@query("select_generalized", f"{_GENERAL} SELECT *, mean_f1 - 0.5 * std_f1 + 0.1 * min_f1 AS generalization_score, 0.5::DOUBLE AS threshold FROM gg")
def select_generalized(spark, d):
    return selection.select_generalized(_folded(spark, d))


_PICK = lambda order: f"{_FOLDED} SELECT target, fold, accuracy, f1, prior_gap FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {order}, fold) AS r FROM fs) WHERE r = 1"


@query("select_by_f1", _PICK("f1 DESC, accuracy DESC, prior_gap"))
def select_by_f1(spark, d):
    return selection.select_by_f1(_folded(spark, d)).select("target", "fold", "accuracy", "f1", "prior_gap")


@query("select_by_accuracy", _PICK("accuracy DESC, f1 DESC"))
def select_by_accuracy(spark, d):
    return selection.select_by_accuracy(_folded(spark, d)).select("target", "fold", "accuracy", "f1", "prior_gap")


@query("cv_summary", f"{_FOLDED} SELECT 'length' AS strategy, target, avg(accuracy) AS accuracy, avg(f1) AS f1, avg(positive_rate) AS positive_rate FROM fs GROUP BY target")
def cv_summary(spark, d):
    return scores.cv_summary(_folded(spark, d))


@query("leaderboard", f"{_GRID} SELECT target, shrink_alpha, avg(logloss) AS mean_logloss FROM gs GROUP BY ALL")
def leaderboard(spark, d):
    return scores.mean_by(_grid(spark, d), "target", "shrink_alpha")


@query("fold_means", f"{_GRID} SELECT target, avg(logloss) AS logloss, count(DISTINCT fold) AS folds FROM gs GROUP BY target")
def fold_means(spark, d):
    return scores.fold_mean(_grid(spark, d), "target")


@query("top3_suppliers", "SELECT s_nationkey, s_suppkey, s_acctbal, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 3")
def top3_suppliers(spark, d):
    return sinks.top_rows(_t(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), [F.col("s_acctbal").desc(), "s_suppkey"], ["s_nationkey"])


# ---- assembly, chained features, sinks

@query("shifted_split_sums", """WITH e AS (SELECT user_id::VARCHAR AS subject_id, (ts - INTERVAL 6 HOURS)::DATE AS date, hour(ts) AS h, value FROM events)
SELECT subject_id, date, sum(value) FILTER (h BETWEEN 6 AND 19) AS day, sum(value) FILTER (NOT h BETWEEN 6 AND 19) AS night, avg(value) FILTER (h BETWEEN 20 AND 23) AS presleep, avg(value) FILTER (h BETWEEN 0 AND 6) AS sleep FROM e GROUP BY ALL""", dates=("date",))
def shifted_split_sums(spark, d):
    rows = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("subject_id"), F.col("ts").alias("timestamp"), "value")
    day = chained.hours(*chained.DAY_HOURS)
    mean = lambda h: F.avg(F.when(chained.hours(*h), F.col("value")))
    return chained.shifted(rows).groupBy(*chained.KEY).agg(chained.split_sum(day, F.col("value")).alias("day"), chained.split_sum(~day, F.col("value")).alias("night"), mean(chained.PRESLEEP).alias("presleep"), mean(chained.SLEEP).alias("sleep"))


@query("dual_features", """WITH a AS (SELECT user_id::VARCHAR AS subject_id, (ts - INTERVAL 6 HOURS)::DATE AS date, avg(value) AS daily_light FROM events GROUP BY ALL),
b AS (SELECT user_id::VARCHAR AS subject_id, (ts - INTERVAL 6 HOURS)::DATE AS date, sum(value) AS daily_steps, sum(2 * value) AS daily_calories FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
j AS (SELECT * FROM b FULL JOIN a USING (subject_id, date))
SELECT subject_id, date, daily_steps, daily_calories, daily_light, isodow(date) - 1 AS dayofweek, """ + ", ".join(f"({c} - avg({c}) OVER w) / (stddev_samp({c}) OVER w + 1e-8) AS {c}_zscore" for c in ("daily_steps", "daily_calories", "daily_light")) + " FROM j WINDOW w AS (PARTITION BY subject_id)", dates=("date",))
def dual_features(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("subject_id"), F.col("ts").alias("timestamp"), "value")
    logs = {"mLight": rows.withColumnRenamed("value", "m_light"), "wPedo": rows.where("event_id % 3 = 0").select("subject_id", "timestamp", F.col("value").alias("step"), (2 * F.col("value")).alias("burned_calories"))}
    return chained.dual_features(logs).withColumn("dayofweek", F.col("dayofweek").cast("long"))


_INPUTS = cross_features.inputs()


@query("cross_features", f"""WITH n AS (SELECT * FROM (VALUES {_values([(x, i) for i, x in enumerate(_INPUTS)])}) t(feature, i)),
f AS (SELECT user_id::VARCHAR AS subject_id, ts::DATE AS lifelog_date, feature, sum(value) AS value FROM events JOIN n ON hour(ts) % 4 = i % 4 AND i <> 3 GROUP BY ALL),
w AS (SELECT subject_id, lifelog_date, {', '.join(f"max(value) FILTER (feature = '{x}') AS {x}" if i != 3 else f"0.0::DOUBLE AS {x}" for i, x in enumerate(_INPUTS))} FROM f GROUP BY ALL), u AS (
""" + " UNION ALL ".join(f"SELECT subject_id, lifelog_date, '{cross_features.PREFIX}{n}' AS feature, ({cross_features._INPUT.sub(lambda m: m[0].replace('/', '_'), e)})::DOUBLE AS value FROM w" for n, e in cross_features.FORMULAS.items()) + ") SELECT * FROM u WHERE value IS NOT NULL", dates=("lifelog_date",))
def cross(spark, d):
    names = [F.array(*[F.lit(x) for i, x in enumerate(_INPUTS) if i % 4 == h and i != 3]) for h in range(4)]
    rows = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("subject_id"), F.to_date("ts").alias("lifelog_date"), (F.hour("ts") % 4).alias("h"), "value")
    # the names of an hour have one sum, so rows are added up before they are named
    sums = rows.groupBy(*stats.KEY, "h").agg(F.sum("value").alias("value"))
    return cross_features.cross_features(sums.select(*stats.KEY, F.explode(F.get(F.array(*names), F.col("h"))).alias("feature"), "value"))


@query("predictions_frame", """WITH t AS (SELECT c_custkey AS row_id, c_name AS subject_id, DATE '2024-01-02' AS sleep_date, DATE '2024-01-01' AS lifelog_date FROM customer)
SELECT subject_id, '2024-01-02' AS sleep_date, '2024-01-01' AS lifelog_date, """ + ", ".join(f"least(greatest((row_id * {i + 1} % 101) / 100.0, 0.0001), 0.9999)::DOUBLE AS {t}" for i, t in enumerate(("Q1", "Q2", "Q3", "S1", "S2", "S3", "S4"))) + " FROM t")
def predictions_frame(spark, d):
    from ..functions.constants import TARGETS

    day = lambda x: F.lit(x).cast("date")
    template = _t(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("subject_id"), day("2024-01-02").alias("sleep_date"), day("2024-01-01").alias("lifelog_date"))
    each = F.array(*[F.struct(F.lit(t).alias("target"), (F.col("row_id") * (i + 1) % 101 / 100).alias("value")) for i, t in enumerate(TARGETS)])
    long = template.select("row_id", F.explode(each).alias("p")).select("row_id", "p.*")
    return sinks.predictions_frame(template, long, as_int=False)


@query("table_shapes", "SELECT 'events' AS name, (SELECT count(*) FROM events) AS n_rows, 6 AS n_columns UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 6 UNION ALL SELECT 'region', (SELECT count(*) FROM region), 2")
def table_shapes(spark, d):
    from ..sources import tables

    return tables.shapes({n: tables.load_table(spark, n, d) for n in ("events", "orders", "region")})


@query("outer_assembly", "SELECT coalesce(a.k, b.k) AS k, n_orders, n_events FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1) b ON a.k = b.k")
def outer_assembly(spark, d):
    """The outer joins of per-table features as one union and one aggregation, as all assembly is done."""
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("t")).unionByName(_t(spark, d, "events").select(F.col("user_id").alias("k"), F.lit("events").alias("t")))
    count = lambda t: F.nullif(F.count_if(F.col("t") == t), F.lit(0)).alias(f"n_{t}")
    return rows.groupBy("k").agg(count("orders"), count("events"))


@query("left_attach", "SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def left_attach(spark, d):
    right = _t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment", "c_acctbal")
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(right, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment", "c_acctbal")


# ---- models: no SQL form

@query("logistic_by_group")
def logistic_by_group(spark, d):
    """Held-out probabilities of the numpy logistic fit: history features of user days, the last quarter held out."""
    rows = history.label_history(_labels(spark, d))
    masked = folds.temporal_mask(rows).withColumn("fold", F.lit("temporal"))
    x = F.array(*[F.coalesce(F.col(c), F.lit(0.5)) for c in history.COLUMNS])
    return models.logistic_by_group(masked.withColumn("x", x), ["target", "fold"])


# ---- fits of many label sets at once: SQL unrolls their steps

_PAST = [c for c in history.COLUMNS if c != "change_rate"]
_SETS = list(ROLLING_MASKS)
_ROLED = f"""WITH h AS (FROM ({SQL['label_history']})), m AS (FROM ({SQL['rolling_masks']})),
u AS ({' UNION ALL '.join(f"SELECT row_id, {i} AS i, coalesce({c}, 0.5) AS v FROM h" for i, c in enumerate(_PAST))}),
r AS (SELECT fold, row_id, y, is_valid FROM m JOIN h USING (row_id))"""


def _roled(spark, d):
    """Label rows with their history as features, and the three rolling folds as roles."""
    rows = history.label_history(_labels(spark, d))
    valid = folds.rolling_masks(rows).groupBy("row_id").agg(*[F.max(F.when(F.col("fold") == f, F.col("is_valid"))).alias(f) for f in _SETS])
    x, roles = F.array(*[F.coalesce(F.col(c), F.lit(0.5)) for c in _PAST]), F.array(*[F.when(F.col(f), 2).otherwise(F.col("y").cast("int")) for f in _SETS])
    return rows.join(valid, "row_id").select("row_id", x.alias("x"), roles.alias("roles"))


def _by_fold(p):
    return p.select("row_id", F.get(F.array(*map(F.lit, _SETS)), F.col("fit")).alias("fold"), "p")


def _descent(steps: int) -> str:
    n, t = len(_PAST), [f"""t0 AS (SELECT fold, i, CASE WHEN i = {len(_PAST)} THEN ln(q / (1 - q)) ELSE 0 END AS th FROM rate, (SELECT unnest(range({len(_PAST) + 1})) AS i))"""]
    for k in range(steps):
        t.append(f"""t{k + 1} AS (SELECT fold, i, th - {0.08 / (1 + k / 250)!r} * (g + CASE WHEN i < {n} THEN 0.01 * th ELSE 0 END) AS th FROM t{k} JOIN (
  SELECT fold, i, sum((1 / (1 + exp(-greatest(-30, least(30, s)))) - y) * CASE WHEN y = 1 THEN 0.5 / q ELSE 0.5 / (1 - q) END / n * z) AS g
  FROM z JOIN (SELECT fold, row_id, sum(z * th) AS s FROM z JOIN t{k} USING (fold, i) GROUP BY ALL) USING (fold, row_id) JOIN rate USING (fold) WHERE NOT is_valid GROUP BY ALL) USING (fold, i))""")
    return f"""{_ROLED}, rate AS (SELECT fold, avg(y) AS q, count(*) AS n FROM r WHERE NOT is_valid GROUP BY 1),
ms AS (SELECT fold, i, avg(v) AS mu, stddev_pop(v) AS sd FROM r JOIN u USING (row_id) WHERE NOT is_valid GROUP BY ALL),
z AS (SELECT fold, row_id, y, is_valid, i, greatest(-8, least(8, (v - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END)) AS z FROM r JOIN u USING (row_id) JOIN ms USING (fold, i) UNION ALL SELECT fold, row_id, y, is_valid, {n}, 1.0 FROM r),
{', '.join(t)} SELECT fold, row_id, 1 / (1 + exp(-greatest(-30, least(30, sum(z * th))))) AS p FROM z JOIN t{steps} USING (fold, i) WHERE is_valid GROUP BY ALL"""


@query("logistic_folds", _descent(5))
def logistic_folds(spark, d):
    """Five steps of the balanced logistic descent for three folds at once, a pass each."""
    return _by_fold(folded.logistic(_roled(spark, d), steps=5, local=0))


_TWO = ("last_value", "last_7_mean")


def _lowest(machine: bool, c: float, steps: int) -> str:
    """Newton's steps for two features and a bias, the three by three systems solved by cofactors."""
    error, bend, bias = ("-2 * w * sg * greatest(1 - sg * f, 0)", "CASE WHEN sg * f < 1 THEN 2 * w ELSE 0 END", 1) if machine else ("w * (1 / (1 + exp(-f)) - y)", "w / (1 + exp(-f)) / (1 + exp(f))", 0)
    t = ["t0 AS (SELECT DISTINCT fold, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM z)"]
    for k in range(steps):
        t.append(f"""l{k} AS (SELECT z.*, a, b, c, a * z1 + b * z2 + c AS f FROM z JOIN t{k} USING (fold) WHERE NOT is_valid),
s{k} AS (SELECT fold, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(a) + sum({error} * z1) AS g1, any_value(b) + sum({error} * z2) AS g2, {bias} * any_value(c) + sum({error}) AS g3,
  1 + sum({bend} * z1 * z1) AS h11, sum({bend} * z1 * z2) AS h12, sum({bend} * z1) AS h13, 1 + sum({bend} * z2 * z2) AS h22, sum({bend} * z2) AS h23, {bias} + sum({bend}) AS h33 FROM l{k} GROUP BY 1),
d{k} AS (SELECT *, h22 * h33 - h23 * h23 AS i11, h13 * h23 - h12 * h33 AS i12, h12 * h23 - h13 * h22 AS i13, h11 * h33 - h13 * h13 AS i22, h12 * h13 - h11 * h23 AS i23, h11 * h22 - h12 * h12 AS i33 FROM s{k}),
t{k + 1} AS (SELECT fold, a - (i11 * g1 + i12 * g2 + i13 * g3) / (h11 * i11 + h12 * i12 + h13 * i13) AS a, b - (i12 * g1 + i22 * g2 + i23 * g3) / (h11 * i11 + h12 * i12 + h13 * i13) AS b, c - (i13 * g1 + i23 * g2 + i33 * g3) / (h11 * i11 + h12 * i12 + h13 * i13) AS c FROM d{k})""")
    of = [f"coalesce({x}, 0.5)" for x in _TWO]
    return f"""{_ROLED}, v AS (SELECT r.*, {of[0]} AS v1, {of[1]} AS v2 FROM r JOIN h USING (row_id)),
ms AS (SELECT fold, avg(v1) AS m1, stddev_pop(v1) AS d1, avg(v2) AS m2, stddev_pop(v2) AS d2, count(*) AS n, sum(y) AS ones FROM v WHERE NOT is_valid GROUP BY 1),
z AS (SELECT fold, row_id, y, is_valid, 2 * y - 1 AS sg, (v1 - m1) / CASE WHEN d1 > 0 THEN d1 ELSE 1 END AS z1, (v2 - m2) / CASE WHEN d2 > 0 THEN d2 ELSE 1 END AS z2, {c} * n / 2 / CASE WHEN y = 1 THEN ones ELSE n - ones END AS w FROM v JOIN ms USING (fold)),
{', '.join(t)} SELECT fold, row_id, round(1 / (1 + exp(-(a * z1 + b * z2 + c))), 9) AS p FROM z JOIN t{steps} USING (fold) WHERE is_valid"""


def _of_two(spark, d):
    return _roled(spark, d).withColumn("x", F.array(*[F.get("x", F.lit(_PAST.index(c))) for c in _TWO]))


@query("logistic_regressions", _lowest(False, 0.5, 9))
def logistic_regressions(spark, d):
    """Optima of the drawn-in logistic loss for three folds at once, a pass for each point tried."""
    return _by_fold(folded.regressions(_of_two(spark, d), local=0)).withColumn("p", F.round("p", 9))


@query("linear_machines", _lowest(True, 0.2, 12))
def linear_machines(spark, d):
    """Optima of the drawn-in squared hinge for three folds at once, a pass for each point tried."""
    return _by_fold(folded.linear_machines(_of_two(spark, d), local=0)).withColumn("p", F.round("p", 9))


_STUMPS = trees.Ensemble(3, 0.3, leaves=2, l2=0.2, min_rows=20)


def _stumps(s) -> str:
    t = ["f0 AS (SELECT r.*, ln(avg(y) FILTER (NOT is_valid) OVER (PARTITION BY fold) / (1 - avg(y) FILTER (NOT is_valid) OVER (PARTITION BY fold))) AS f FROM r)"]
    worth = lambda g, h: f"(({g}) / 1073741824.0) * (({g}) / 1073741824.0) / (({h}) / 1073741824.0 + {s.l2})"
    for k in range(s.rounds):
        t.append(f"""d{k} AS (SELECT fold, row_id, round_even((1 / (1 + exp(-f)) - y) * 1073741824, 0)::BIGINT AS g, round_even(1 / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f))) * 1073741824, 0)::BIGINT AS h FROM f{k} WHERE NOT is_valid),
v{k} AS (SELECT fold, i, v, count(*) AS n, sum(g) AS g, sum(h) AS h FROM d{k} JOIN u USING (row_id) GROUP BY ALL),
l{k} AS (SELECT fold, i, cut, sum(n) FILTER (v <= cut) AS nl, sum(g) FILTER (v <= cut) AS gl, sum(h) FILTER (v <= cut) AS hl, sum(n) AS n, sum(g) AS g, sum(h) AS h FROM v{k} JOIN cuts USING (i) GROUP BY ALL),
b{k} AS (SELECT *, {worth('gl', 'hl')} + {worth('g - gl', 'h - hl')} - {worth('g', 'h')} AS gain FROM l{k} WHERE nl >= {s.min_rows} AND n - nl >= {s.min_rows}),
s{k} AS (SELECT * FROM b{k} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, i, cut) = 1),
f{k + 1} AS (SELECT f.fold, f.row_id, f.y, f.is_valid, f.f - {s.rate} * coalesce(CASE WHEN u.v <= s.cut THEN s.gl / 1073741824.0 / (s.hl / 1073741824.0 + {s.l2}) ELSE (s.g - s.gl) / 1073741824.0 / ((s.h - s.hl) / 1073741824.0 + {s.l2}) END, 0) AS f
  FROM f{k} f LEFT JOIN s{k} s ON s.fold = f.fold LEFT JOIN u ON u.row_id = f.row_id AND u.i = s.i)""")
    return f"""{_ROLED}, cuts AS (SELECT i, (v + lead(v) OVER (PARTITION BY i ORDER BY v)) / 2 AS cut FROM (SELECT DISTINCT i, v FROM u) QUALIFY cut IS NOT NULL),
{', '.join(t)} SELECT fold, row_id, 1 / (1 + exp(-f)) AS p FROM f{s.rounds} WHERE is_valid"""


@query("boosted_stumps", _stumps(_STUMPS))
def boosted_stumps(spark, d):
    """Three rounds of boosted stumps for three folds at once."""
    return _by_fold(trees.grow(_roled(spark, d), [trees.Fit(k, _STUMPS) for k in range(len(_SETS))], len(_SETS))[0])


@query("tree_ensembles")
def tree_ensembles(spark, d):
    """A leaf-wise, a level-wise, an oblivious and a random ensemble and a forest of five rounds, for three folds in the same passes."""
    kinds = {"leaf": trees.Ensemble(5, 0.1, leaves=7, min_rows=20), "level": trees.Ensemble(5, 0.1, depth=3, l1=1.0, l2=1.0, rows=0.65, columns=0.65, grow="level"), "same": trees.Ensemble(5, 0.1, depth=3, l2=8.0, grow="same"), "random": trees.Ensemble(5, depth=4, min_rows=2, balanced=True, grow="random"), "forest": trees.Ensemble(5, depth=4, min_rows=3, balanced=True, grow="forest")}
    fits = [trees.Fit(k, s) for s in kinds.values() for k in range(len(_SETS))]
    p = trees.grow(_roled(spark, d), fits, len(_SETS))[0]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("fit") / len(_SETS)).cast("int")).alias("kind")
    return p.select(kind, F.get(F.array(*map(F.lit, _SETS)), F.col("fit") % len(_SETS)).alias("fold"), "row_id", "p")


@query("kernel_machines")
def kernel_machines(spark, d):
    """Held-out probabilities of the radial kernel machine, for three folds at once."""
    return _by_fold(folded.kernel_machines(_roled(spark, d), landmarks=128, passes=20))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
