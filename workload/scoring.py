"""Feature vectors, models, scores, ranking."""


from pyspark.sql import functions as F

from sparktide.functions.numbers import anomaly_score, mean_distance
from sparktide.operators import anomaly as M
from sparktide.operators.store import MICROS_PER_SLICE, store_points
from sparktide.sources.tables import samples_from_table
from workload.inputs import EV, PT, events, micros, points, query, r6, table, utc
from workload.storing import stored_tiers

_X = """fd AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY sec) AS d FROM pt),
fm AS (SELECT *, CASE WHEN count(d) OVER w = 3 THEN avg(d) OVER w END AS m FROM fd
  WINDOW w AS (PARTITION BY series_id ORDER BY sec ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
fx AS (SELECT *, """ + ", ".join(f"lag(m, {5 - i}) OVER w AS x{i}" for i in range(6)) + """ FROM fm
  WINDOW w AS (PARTITION BY series_id ORDER BY sec))"""


@query("feature_vectors", f"WITH {PT}, {_X} SELECT series_id, sec * 1000000 AS ts_us, "
       + ", ".join(f"round(x{i}, 6) AS x{i}" for i in range(6)) + " FROM fx WHERE x0 IS NOT NULL")
def vectors(spark, sf):
    out = M.feature_vectors(stored_tiers(spark, sf)["raw"])
    return out.select("series_id", micros("ts"), *[r6(F.col("x")[i], f"x{i}") for i in range(6)])


_C0, _C1 = [0.0] * 6, [10.0, -10.0, 5.0, -5.0, 1.0, 0.0]


def _sql_distance(c):
    return "sqrt(" + " + ".join(f"(x{i} - ({v}::DOUBLE)) * (x{i} - ({v}::DOUBLE))" for i, v in enumerate(c)) + ")"


@query("anomaly_score", f"""WITH {PT}, {_X} SELECT series_id, sec * 1000000 AS ts_us,
  round(({_sql_distance(_C0)} + {_sql_distance(_C1)}) / 2, 6) AS distance,
  round(least(100, 100 * abs((({_sql_distance(_C0)} + {_sql_distance(_C1)}) / 2 - 10) / 90)), 6) AS score
FROM fx WHERE x0 IS NOT NULL""")
def scores(spark, sf):
    """Scores against two fixed centroids."""
    c0, c1 = F.array(*[F.lit(v) for v in _C0]), F.array(*[F.lit(v) for v in _C1])
    out = M.feature_vectors(points(spark, sf)).withColumn("d", mean_distance(F.col("x"), c0, c1, 6))
    score = anomaly_score(F.col("d"), F.lit(10.0), F.lit(100.0))
    return out.select("series_id", micros("ts"), r6("d", "distance"), r6(score, "score"))


_GRID = dict(every_s=5 * 86400, start=utc(2024, 1, 5), end=utc(2024, 1, 31), window_s=10 * 86400)


def gap_sql(c):
    """Distance of a vector and a centroid of six values."""
    return "sqrt(" + " + ".join(f"(x{i} - {c}[{i + 1}]) * (x{i} - {c}[{i + 1}])" for i in range(6)) + ")"


_SIX = ", ".join(f"x{i}" for i in range(6))
# A model for each series and training time: vectors within the window, seeds, and rounds until no vector changes sides.
def models_sql(points, times, window_s):
    return f"""{points}, tr AS ({times}),
wd AS (SELECT series_id, t, sec, value - lag(value) OVER w AS d
  FROM pt JOIN tr ON sec BETWEEN t - {window_s} AND t WINDOW w AS (PARTITION BY series_id, t ORDER BY sec)),
wm AS (SELECT *, CASE WHEN count(d) OVER w = 3 THEN avg(d) OVER w END AS m FROM wd
  WINDOW w AS (PARTITION BY series_id, t ORDER BY sec ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
wx AS (SELECT series_id, t, sec, {", ".join(f"lag(m, {5 - i}) OVER w AS x{i}" for i in range(6))} FROM wm WINDOW w AS (PARTITION BY series_id, t ORDER BY sec)),
ve AS (SELECT *, row_number() OVER (PARTITION BY series_id, t ORDER BY sec) AS n FROM wx WHERE x0 IS NOT NULL),
fi AS (SELECT series_id, t, [{_SIX}] AS c0 FROM ve WHERE n = 1),
se AS (SELECT ve.series_id, ve.t, any_value(c0) AS c0, arg_max([{_SIX}], ({gap_sql("c0")}, -n)) AS c1
  FROM ve JOIN fi ON ve.series_id = fi.series_id AND ve.t = fi.t GROUP BY 1, 2 HAVING count(*) >= 2),
ro AS (
  SELECT series_id, t, 0 AS round, c0, c1, '' AS sides FROM se
  UNION ALL
  SELECT series_id, t, round + 1, CASE WHEN near > 0 THEN a0 ELSE c0 END, CASE WHEN near < whole THEN a1 ELSE c1 END, new_sides FROM (
    SELECT series_id, t, round, c0, c1, sides, count(*) AS whole, count_if(NOT far) AS near, string_agg(CASE WHEN far THEN '1' ELSE '0' END, '' ORDER BY n) AS new_sides,
           [{", ".join(f"avg(x{i}) FILTER (NOT far)" for i in range(6))}] AS a0, [{", ".join(f"avg(x{i}) FILTER (far)" for i in range(6))}] AS a1
    FROM (SELECT ro.*, n, {_SIX}, {gap_sql("c0")} > {gap_sql("c1")} AS far FROM ro JOIN ve ON ro.series_id = ve.series_id AND ro.t = ve.t)
    GROUP BY series_id, t, round, c0, c1, sides)
  WHERE new_sides <> sides AND round < 500),
la AS (SELECT * FROM ro QUALIFY row_number() OVER (PARTITION BY series_id, t ORDER BY round DESC) = 1),
mo AS (SELECT la.series_id, la.t, any_value(c0) AS c0, any_value(c1) AS c1, min(({gap_sql("c0")} + {gap_sql("c1")}) / 2) AS lo, max(({gap_sql("c0")} + {gap_sql("c1")}) / 2) AS hi
  FROM la JOIN ve ON la.series_id = ve.series_id AND la.t = ve.t GROUP BY 1, 2)"""


_MODELS = models_sql(PT, """SELECT t FROM (
  SELECT unnest(range(0, 7)) * 432000 + (epoch(TIMESTAMP '2024-01-05')::BIGINT + 431999) // 432000 * 432000 AS t)
  WHERE t <= epoch(TIMESTAMP '2024-01-31')""", 864000)


@query("train_models", f"""WITH RECURSIVE {_MODELS} SELECT series_id, t * 1000000 AS trained_at_us,
  {", ".join(f"round(c{k}[{i + 1}] + 1e-8::DOUBLE, 6) AS c{k}_{i}" for k in (0, 1) for i in range(6))}, round(lo, 6) AS min_dist, round(hi, 6) AS max_dist FROM mo""")
def models(spark, sf):
    """One model per series every five days from ten days of points.

    The shift keeps means that end in an exact half from rounding either way.
    """
    out = M.train_models(stored_tiers(spark, sf)["raw"], **_GRID)
    return out.select(
        "series_id", micros("trained_at"), *[r6(F.col("c0")[i] + 1e-8, f"c0_{i}") for i in range(6)],
        *[r6(F.col("c1")[i] + 1e-8, f"c1_{i}") for i in range(6)], r6("min_dist"), r6("max_dist"),
    )


@query("train_models_all_rounds", f"""WITH RECURSIVE {_MODELS}
SELECT series_id, t * 1000000 AS trained_at_us, round(lo, 6) AS min_dist, round(hi, 6) AS max_dist FROM mo""")
def models_all_rounds(spark, sf):
    """The same with every one of the 500 rounds run."""
    return M.train_models(stored_tiers(spark, sf)["raw"], early_stop=False, **_GRID).select(
        "series_id", micros("trained_at"), r6("min_dist"), r6("max_dist"))


_SUPPLIES = """pt AS (
  SELECT 'extendedprice{supplier="' || l_suppkey || '"}' AS series_id, epoch_us(l_shipdate) // 1000000 AS sec, min(l_extendedprice) AS value
  FROM lineitem GROUP BY 1, 2)"""


@query("train_models_suppliers", f"""WITH RECURSIVE {models_sql(_SUPPLIES, "SELECT epoch(TIMESTAMP '2002-01-01')::BIGINT AS t", 8 * 365 * 86400)}
SELECT series_id, t * 1000000 AS trained_at_us, round(lo + 1e-8::DOUBLE, 4) AS min_dist, round(hi + 1e-8::DOUBLE, 4) AS max_dist FROM mo""")
def models_by_supplier(spark, sf):
    """One model per supplier from all its order lines: many series in one batch."""
    rows = samples_from_table(
        table(spark, sf, "lineitem"), name="extendedprice", ts="l_shipdate", value="l_extendedprice",
        labels={"supplier": F.col("l_suppkey")}, seq=F.unix_micros(F.col("l_shipdate").cast("timestamp")),
    )
    out = M.train_models(store_points(rows, 365 * 4 * MICROS_PER_SLICE), train_at=[utc(2002, 1, 1)], window_s=8 * 365 * 86400)
    # sums of squares of prices lose the last digits differently in either engine
    shown = [F.round(F.col(c) + 1e-8, 4).alias(c) for c in ("min_dist", "max_dist")]
    return out.select("series_id", micros("trained_at"), *shown)


@query("score_trained", f"""WITH RECURSIVE {_MODELS}, {_X},
cand AS (SELECT fx.series_id, fx.sec, lo, hi, ({gap_sql("c0")} + {gap_sql("c1")}) / 2 AS d,
    row_number() OVER (PARTITION BY fx.series_id, fx.sec ORDER BY t DESC) AS rk
  FROM fx JOIN mo ON fx.series_id = mo.series_id AND mo.t <= fx.sec WHERE x0 IS NOT NULL),
vote AS (SELECT series_id, sec, bool_and(CASE WHEN lo = hi THEN 0 ELSE least(100, 100 * abs((d - lo) / (hi - lo))) END >= 60) AS a
  FROM cand WHERE rk <= {M.MODEL_COUNT} GROUP BY 1, 2)
SELECT pt.series_id, pt.sec * 1000000 AS ts_us, pt.value, coalesce(vote.a, false) AS anomalous
FROM pt LEFT JOIN vote ON pt.series_id = vote.series_id AND pt.sec = vote.sec""")
def scored(spark, sf):
    """Points judged by the trained models in force at their time."""
    p = stored_tiers(spark, sf)["raw"]
    trained = M.train_models(p, **_GRID)
    return M.score_samples(p, trained, threshold=60.0).select("series_id", micros("ts"), "value", "anomalous")


def _plain_models(p):
    """A model table SQL can compute too: spread of each five-day period around fixed directions."""
    period = F.col("sec") - F.pmod(F.col("sec"), F.lit(432000))
    spread = p.groupBy("series_id", period.alias("p")).agg(F.round(F.avg("value"), 3).alias("a"), F.round(F.max("value"), 3).alias("b"))
    return spread.select(
        "series_id", F.timestamp_seconds(F.col("p") + 432000).alias("trained_at"),
        F.array(*[F.lit(0.0)] * 6).alias("c0"),
        F.array(*[F.col("a") / 10] * 6).alias("c1"), F.lit(0.0).alias("min_dist"), (F.col("b") * 0.4).alias("max_dist"),
    )


@query("score_samples", f"""WITH {PT}, {_X}, md AS (
  SELECT series_id, (p + 432000) AS trained, round(a, 3) / 10 AS c, round(b, 3) * 0.4::DOUBLE AS hi FROM (
    SELECT series_id, sec - sec % 432000 AS p, avg(value) AS a, max(value) AS b FROM pt GROUP BY 1, 2)),
cand AS (SELECT fx.series_id, fx.sec, hi,
    ({" + ".join(f"x{i}*x{i}" for i in range(6))}) AS q0, ({" + ".join(f"(x{i}-c)*(x{i}-c)" for i in range(6))}) AS q1,
    row_number() OVER (PARTITION BY fx.series_id, fx.sec ORDER BY trained DESC) AS rk
  FROM fx JOIN md ON fx.series_id = md.series_id AND md.trained <= fx.sec WHERE x0 IS NOT NULL),
vote AS (SELECT series_id, sec, bool_and(least(100, 100 * abs(((sqrt(q0) + sqrt(q1)) / 2) / hi)) >= 70) AS a
  FROM cand WHERE rk <= 3 GROUP BY 1, 2)
SELECT pt.series_id, pt.sec * 1000000 AS ts_us, pt.value, coalesce(vote.a, false) AS anomalous
FROM pt LEFT JOIN vote ON pt.series_id = vote.series_id AND pt.sec = vote.sec""")
def voted(spark, sf):
    p = stored_tiers(spark, sf)["raw"]
    out = M.score_samples(p, _plain_models(p), model_count=3, threshold=70.0)
    return out.select("series_id", micros("ts"), "value", "anomalous")


@query("newest_models", f"""WITH {PT}, md AS (SELECT series_id, sec - sec % 432000 + 432000 AS t FROM pt GROUP BY 1, 2)
SELECT series_id, t * 1000000 AS trained_at_us FROM md
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t DESC) <= 3""")
def kept_models(spark, sf):
    return M.newest_models(_plain_models(points(spark, sf)), 3).select("series_id", micros("trained_at"))


@query("anomaly_ranking", f"""WITH {EV} SELECT series_id, round(count_if(value > 100) / count(*), 6) AS rate, count(*) AS count FROM ev
WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-15') AND epoch_us(TIMESTAMP '2024-01-25') GROUP BY series_id HAVING count_if(value > 100) > 0""")
def ranking(spark, sf):
    rows = events(spark, sf).withColumn("anomalous", F.col("value") > 100)
    out = M.anomaly_ranking(rows, utc(2024, 1, 25), 10 * 86400)
    return out.select("series_id", r6("rate"), "count")


