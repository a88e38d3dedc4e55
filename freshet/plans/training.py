"""Queries on training samples, registered fitters, and draws of mixtures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import mixture
from freshet.operators import registries, training
from freshet.operators.training import SampleRules
from freshet.plans import base, samples_and_models
from freshet.plans.base import VIEWS, query

R = lambda c, n=6: F.round(c, n)
LEADS = [1, 2, 3]
RULES = SampleRules(hindcast=["q", "alt"], forecast=["fore"], target=["q"], static=["top"], leads=LEADS, length=5, lead_time=3, min_lead=1, overlap=2, predict_last=3,
                    nan_handling="masked_mean", hindcast_groups=[["q"], ["alt"]], forecast_groups=[["fore"]], refuse_zero_targets=True)

#: Daily rows with a forecast of three leads for each issue day, a second feature with gaps of its own, and one static value.
VIEWS |= {
    "issued": """SELECT basin, date, max(sim) FILTER (lead = 1) AS f1, max(sim) FILTER (lead = 2) AS f2, max(sim) FILTER (lead = 3) AS f3 FROM forecast GROUP BY 1, 2""",
    "rows": """SELECT d.basin, d.date, q, CASE WHEN day(d.date) % 5 > 0 THEN q + 1 END AS alt, f1, f2, f3, top FROM daily d LEFT JOIN issued i ON i.basin = d.basin AND i.date = d.date JOIN (SELECT s_nationkey AS basin, CASE WHEN s_nationkey % 5 > 0 THEN max(s_acctbal) END AS top FROM supplier GROUP BY 1) s ON s.basin = d.basin""",
}
_VIEWS = "flow forecast daily issued rows"


def rows(spark, d):
    statics = base.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("basin")).agg(F.max("s_acctbal").alias("top"))
    statics = statics.withColumn("top", F.when(F.col("basin") % 5 > 0, F.col("top")))
    fore = training.lead_arrays(base.forecast(spark, d).withColumnRenamed("sim", "fore"), "basin", "date", "lead", ["fore"], LEADS)
    daily = samples_and_models.daily(spark, d).withColumn("alt", F.when(F.day("date") % 5 > 0, F.col("q") + 1))
    return daily.join(fore, ["basin", "date"], "left").join(statics, "basin")


_MASKS = """m AS (SELECT basin, date, top IS NOT NULL AS statics, (q IS NOT NULL OR alt IS NOT NULL)::INT AS h, f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AS forecasts, (f1 IS NOT NULL)::INT AS o, coalesce(q <> 0, true) AS non_zero_targets, (q IS NOT NULL)::INT AS t, day(date) <> 13 AS dates FROM rows),
w AS (SELECT *, count(*) OVER a = 5 AND min(h) OVER a = 1 AS hindcasts, count(*) OVER b = 2 AND min(o) OVER b = 1 AS forecast_overlap, count(*) OVER c = 3 AND max(t) OVER c = 1 AS targets FROM m
WINDOW a AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY basin ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))"""


@query("sample_masks", f"""WITH {_MASKS} SELECT basin, date, statics, hindcasts, forecasts, forecast_overlap, non_zero_targets, targets, dates, statics AND hindcasts AND forecasts AND forecast_overlap AND non_zero_targets AND targets AND dates AS valid FROM w""", _VIEWS)
def sample_masks(spark, d):
    r = rows(spark, d)
    return training.sample_masks(r, "basin", "date", RULES, r.select("date").where(F.day("date") != 13))


def _text(c):
    return F.array_join(F.transform(c, lambda v: F.round(v).cast("bigint").cast("string")), ",", "NA").alias(c)


_V = lambda c: f"coalesce(round({c})::BIGINT::VARCHAR, 'NA')"


@query("training_samples", f"""WITH {_MASKS}, x AS (SELECT basin, date, list({_V('q')}) OVER a AS x_q, list({_V('alt')}) OVER a AS x_alt, list({_V('f1')}) OVER b AS o, [{_V('f1')}, {_V('f2')}, {_V('f3')}] AS f, list({_V('q')}) OVER c AS y_q FROM rows
WINDOW a AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT basin, date, array_to_string(x_q, ',') AS x_q, array_to_string(x_alt, ',') AS x_alt, array_to_string(list_concat(x.o, f), ',') AS f_fore, array_to_string(y_q, ',') AS y_q
FROM x JOIN w USING (basin, date) WHERE statics AND hindcasts AND forecasts AND forecast_overlap AND non_zero_targets AND targets""", _VIEWS)
def training_samples(spark, d):
    """Whole samples of the days that can issue one; missing days are kept (NA in the text)."""
    r = rows(spark, d)
    valid = training.sample_masks(r, "basin", "date", RULES).where("valid").select("basin", "date")
    built = training.build_samples(r, "basin", "date", RULES).join(valid, ["basin", "date"], "left_semi")
    return built.select("basin", "date", *[_text(c) for c in ("x_q", "x_alt", "f_fore", "y_q")])


@query("unioned_features", """SELECT basin, date, coalesce(q, lag(f1, 0) OVER w) AS q, coalesce(alt, q) AS alt, coalesce(f1, q) AS f1, coalesce(f2, lead(q, 1) OVER w) AS f2, coalesce(f3, lead(q, 2) OVER w) AS f3 FROM rows WINDOW w AS (PARTITION BY basin ORDER BY date)""", _VIEWS)
def unioned_features(spark, d):
    out = training.union_features(rows(spark, d), "basin", "date", {"q": "fore", "alt": "q", "fore": "q", "none": "q"}, LEADS, ["fore"])
    return out.select("basin", "date", "q", "alt", *[F.get("fore", F.lit(i)).alias(f"f{i + 1}") for i in range(3)])


@query("scored_samples", f"""WITH {_MASKS}, x AS (SELECT basin, date, avg(q) OVER (PARTITION BY basin ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m, f1 FROM rows)
SELECT basin, date, round(m + f1, 6) AS score FROM x JOIN w USING (basin, date) WHERE statics AND hindcasts AND forecasts AND forecast_overlap AND non_zero_targets AND targets AND m IS NOT NULL""", _VIEWS)
def scored_samples(spark, d):
    """The scan that a model runs in; this one adds the mean of the hindcast to the first lead of the issue day."""
    import numpy as np
    import pandas as pd

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        mean = [np.nanmean(np.array(v, float)) if any(x is not None and x == x for x in v) else np.nan for v in batch["x_q"]]
        first = [float(v[RULES.overlap]) for v in batch["f_fore"]]
        return pd.DataFrame({"score": np.round(np.array(mean) + np.array(first), 6)})

    r = rows(spark, d).withColumn("q", F.col("q").cast("double"))
    valid = training.sample_masks(r, "basin", "date", RULES).where("valid").select("basin", "date")
    built = training.build_samples(r, "basin", "date", RULES).join(valid, ["basin", "date"], "left_semi").select("basin", "date", "x_q", "f_fore")
    return training.score_samples(built, model, "score double", ["basin", "date"]).where(~F.isnan("score"))


@query("series_thresholds", """WITH y AS (SELECT basin, year(date) AS year, max(q)::DOUBLE AS peak FROM flow GROUP BY 1, 2 HAVING count(*) >= 45),
e AS (SELECT basin FROM y WHERE peak > 0 GROUP BY 1 HAVING count(*) >= 5 AND max(peak) > min(peak)), f AS (SELECT basin, avg(peak) AS m, stddev_samp(peak) AS s FROM y SEMI JOIN e USING (basin) GROUP BY 1)
SELECT b.basin, t AS period, round(greatest(0, m - sqrt(6) / pi() * (0.5772156649015329 + ln(ln(t / (t - 1)))) * s), 5) AS flow FROM (SELECT DISTINCT basin FROM flow) b, (SELECT unnest([2.0, 10.0, 50.0])::DOUBLE AS t) LEFT JOIN f ON f.basin = b.basin""", "flow")
def series_thresholds(spark, d):
    out = registries.series_thresholds(base.flow(spark, d), "basin", "date", "q", "gumbel", [2, 10, 50], max_missing=320)
    return out.withColumn("flow", R("flow", 5))


_U = lambda s, n: f"((('0x' || substr(md5('9:{s}:' || s_suppkey || ':' || draw{n}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


@query("mixture_samples", f"""WITH d AS (SELECT s_suppkey, s_suppkey % 50 * 1.0::DOUBLE AS mu, unnest(range(20)) AS draw FROM supplier),
u AS (SELECT s_suppkey, draw, {_U('c', '')} < 0.7 AS first, mu, unnest(range(3)) AS try FROM d),
v AS (SELECT s_suppkey, draw, try, {_U('v', " || ':' || try")} AS u, CASE WHEN first THEN mu ELSE mu + 5 END AS m, CASE WHEN first THEN 2.0 ELSE 1.0 END::DOUBLE AS b, CASE WHEN first THEN 0.3 ELSE 0.6 END::DOUBLE AS tau FROM u),
x AS (SELECT s_suppkey, draw, try, CASE WHEN u < tau THEN m + b * ln(u / tau) / (1 - tau) ELSE m - b * ln((1 - u) / (1 - tau)) / tau END AS v FROM v)
SELECT s_suppkey, draw, round(max(v) FILTER (try = 0), 6) AS plain, round(greatest(max(v) FILTER (try = 0), 0), 6) AS clipped, round(coalesce(arg_min(v, try) FILTER (v >= 0), max(v) FILTER (try = 2)), 6) AS truncated FROM x GROUP BY 1, 2""")
def mixture_samples(spark, d):
    from freshet.plans.events_and_networks import _mixtures

    m = _mixtures(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("draw", F.col("draw").cast("bigint"))
    of = lambda how: R(mixture.mixture_sample(F.col("c"), F.col("s_suppkey"), F.col("draw"), "9", how, 0.0, 2))
    return m.select("s_suppkey", "draw", of("none").alias("plain"), of("clip").alias("clipped"), of("truncate").alias("truncated"))
