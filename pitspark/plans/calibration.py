"""Calibration of classifier scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions.mathfn import rnd
from pitspark.operators import calibration as K
from pitspark.operators import strategies as ST
from pitspark.operators.chunked import SeriesKey
from pitspark.operators.sequential import GAMMAS, adaptive_alpha, initial_alphas
from pitspark.plans.aggregates import rv60
from pitspark.plans.registry import query, view
from pitspark.session import materialise
from pitspark.sources.views import Tables

C = F.col

view(
    "probs",
    """SELECT row_id, label, class, fold, slice, present, round(exp(logit / 1.5 - mx) / sum(exp(logit / 1.5 - mx)) OVER (PARTITION BY row_id), 9) AS p FROM
       (SELECT *, max(logit / 1.5) OVER (PARTITION BY row_id) AS mx FROM scorelong)""",
    "scorelong",
)
view(
    "cscores",
    """SELECT *, 1.0 - p + 0.01::DOUBLE * greatest(rk - 1, 0) AS score FROM
       (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, class) AS rk FROM probs)""",
    "probs",
)
view("lscores", "SELECT * FROM cscores WHERE class = label", "cscores")
view(
    "qhats",
    """WITH own AS (SELECT fold, label, count(*) AS n, list_sort(list(score))[greatest(1, least(count(*), ceil((count(*) + 1) * 0.9::DOUBLE)))::INT] AS q FROM lscores WHERE slice = 'c' GROUP BY 1, 2),
       pool AS (SELECT fold, list_sort(list(score))[greatest(1, least(count(*), ceil((count(*) + 1) * 0.9::DOUBLE)))::INT] AS q FROM lscores WHERE slice = 'c' GROUP BY 1),
       g AS (SELECT fold, q AS pooled, k AS label FROM pool, (SELECT DISTINCT class AS k FROM probs))
       SELECT g.fold, g.label, CASE WHEN own.n >= 20 THEN own.q ELSE g.pooled END AS q_hat FROM g LEFT JOIN own USING (fold, label)""",
    "lscores probs",
)
view(
    "sets",
    """SELECT c.row_id, any_value(c.fold) AS fold, any_value(c.label) AS label, any_value(present) AS present, any_value(slice) AS slice,
              coalesce(string_agg(class::VARCHAR, '|' ORDER BY class) FILTER (WHERE score <= q_hat), '') AS members,
              coalesce(min(p) FILTER (WHERE score <= q_hat), 0) AS lower_bound, bool_or(score <= q_hat AND class = c.label) AS covered
       FROM cscores c JOIN qhats q ON q.fold = c.fold AND q.label = c.class GROUP BY 1""",
    "cscores qhats",
)


def probs(t: Tables):
    return K.probabilities(t.scores, 1.5)


def sets(t: Tables):
    rows = materialise(K.with_scores(probs(t)))
    q = K.fit_quantiles(rows.filter(C("slice") == "c"), ["fold"])
    return K.with_sets(rows, q, ["fold"])


_GRID = """WITH g AS (SELECT fold, t, avg(nll) AS loss FROM (
      SELECT fold, row_id, t, ln(sum(exp(logit / t - mx / t))) + max(mx / t) - max(logit / t) FILTER (WHERE class = label) AS nll FROM
        (SELECT *, max(logit) OVER (PARTITION BY row_id) AS mx FROM scorelong WHERE slice = 'b'), (SELECT 0.7::DOUBLE + i * 0.1::DOUBLE AS t FROM range(24) r(i)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    r AS (SELECT fold, arg_min(t, loss) AS t0 FROM g GROUP BY 1),
    f AS (SELECT fold, t, avg(nll) AS loss FROM (
      SELECT s.fold, row_id, t, ln(sum(exp(logit / t - mx / t))) + max(mx / t) - max(logit / t) FILTER (WHERE class = label) AS nll FROM
        (SELECT *, max(logit) OVER (PARTITION BY row_id) AS mx FROM scorelong WHERE slice = 'b') s
        JOIN (SELECT fold, greatest(least(t0 + i * 0.005::DOUBLE, 3.0), 0.7)::DOUBLE AS t FROM r, range(-20, 21) q(i)) USING (fold) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("temperature_fit", f"{_GRID} SELECT fold, round(arg_min(t, loss), 6) AS temperature FROM f GROUP BY 1", "scorelong")
def temperature_fit(t: Tables):
    """Temperature per fold on the fitting slice."""
    out = K.fit_temperature(t.scores.filter(C("slice") == "b"), ["fold"])
    return out.select("fold", rnd(C("temperature")).alias("temperature"))


@query("raps_score", "SELECT row_id, fold, label, round(score, 6) AS score FROM lscores", "lscores")
def raps_score(t: Tables):
    """Conformity score of each row's label."""
    return K.with_scores(probs(t)).select("row_id", "fold", "label", rnd(C("score")).alias("score"))


@query("raps_quantile", "SELECT fold, label, round(q_hat, 6) AS q_hat FROM qhats", "qhats")
def raps_quantile(t: Tables):
    """Class-conditional score quantiles with pooled fallback."""
    rows = materialise(K.with_scores(probs(t)).filter(C("slice") == "c"))
    return K.fit_quantiles(rows, ["fold"]).select("fold", "label", rnd(C("q_hat")).alias("q_hat"))


@query("prediction_set", "SELECT row_id, fold, members FROM sets", "sets")
def prediction_set(t: Tables):
    """Classes whose score stays under their quantile."""
    return sets(t).select("row_id", "fold", F.array_join(C("members").cast("array<string>"), "|").alias("members"))


@query("set_lower_bound", "SELECT row_id, fold, round(lower_bound, 6)::DOUBLE AS lower_bound FROM sets", "sets")
def set_lower_bound(t: Tables):
    """Smallest probability inside the set."""
    return sets(t).select("row_id", "fold", rnd(C("lower_bound")).alias("lower_bound"))


@query(
    "coverage",
    """SELECT fold, CASE WHEN present THEN 'present' ELSE 'absent' END AS bucket, round(avg(covered::INT), 6) AS coverage, count(*) AS n FROM sets GROUP BY 1, 2
       UNION ALL SELECT fold, 'both', round(avg(covered::INT), 6), count(*) FROM sets GROUP BY 1""",
    "sets",
)
def coverage(t: Tables):
    """Share of rows whose label is in the set, per bucket and overall."""
    own = F.when(C("present"), "present").otherwise("absent")
    b = sets(t).select("fold", "covered", F.explode(F.array(own, F.lit("both"))).alias("bucket"))
    return b.groupBy("fold", "bucket").agg(
        rnd(F.avg(C("covered").cast("double"))).alias("coverage"), F.count(F.lit(1)).alias("n")
    )


@query("pos_gated", """SELECT s.row_id, s.fold, round(CASE WHEN lower_bound >= 0.40 THEN hi - lo ELSE 0 END, 6)::DOUBLE + 0.0 AS position FROM sets s
       JOIN (SELECT row_id, max(p) FILTER (WHERE class = 9) AS hi, max(p) FILTER (WHERE class = 0) AS lo FROM probs GROUP BY 1) p USING (row_id)""", "sets probs")
def pos_gated(t: Tables):
    """Model weight behind the lower-bound gate."""
    w = F.get("probs", F.lit(9)) - F.get("probs", F.lit(0))
    return sets(t).select("row_id", "fold", rnd(ST.gated(w, C("lower_bound"))).alias("position"))


def _alpha_sql() -> str:
    n = len(GAMMAS)
    start = initial_alphas()
    a0 = ", ".join(f"{float(x)!r}::DOUBLE AS a{i}" for i, x in enumerate(start))
    w0 = ", ".join(f"0.2::DOUBLE AS w{i}" for i in range(n))
    upd = [f"least(greatest(r.a{i} + {float(g)!r}::DOUBLE * (0.1::DOUBLE - m.missed), 0.001::DOUBLE), 0.5::DOUBLE)" for i, g in enumerate(GAMMAS)]
    raw = [
        f"(r.w{i} + 1e-12::DOUBLE) * exp(-0.01::DOUBLE * CASE WHEN m.missed >= {u} THEN 0.1::DOUBLE * (m.missed - {u}) ELSE -0.9::DOUBLE * (m.missed - {u}) END)"
        for i, u in enumerate(upd)
    ]
    tot = " + ".join(raw)
    agg = "least(greatest(" + " + ".join(f"a{i} * w{i}" for i in range(n)) + ", 0.001), 0.5)"
    return f"""WITH RECURSIVE m AS (SELECT fold, row_id, (NOT covered)::INT::DOUBLE AS missed, row_number() OVER (PARTITION BY fold ORDER BY row_id) AS rn FROM sets WHERE slice = 'c'),
      r AS (SELECT fold, 0::BIGINT AS rn, NULL::BIGINT AS row_id, {a0}, {w0} FROM (SELECT DISTINCT fold FROM m)
        UNION ALL SELECT m.fold, m.rn, m.row_id, {', '.join(upd)}, {', '.join(f'({x}) / ({tot})' for x in raw)} FROM r JOIN m ON m.fold = r.fold AND m.rn = r.rn + 1),
      v AS (SELECT fold, rn, row_id, {agg} AS alpha_next FROM r)
      SELECT fold, row_id, round(lag(alpha_next) OVER (PARTITION BY fold ORDER BY rn), 6) AS alpha, round(alpha_next, 6) AS alpha_next FROM v QUALIFY row_id IS NOT NULL"""


@query("adaptive_alpha", _alpha_sql(), "sets")
def adaptive_alpha_query(t: Tables):
    """Online miscoverage level by expert aggregation."""
    rows = materialise(sets(t).filter(C("slice") == "c").select("fold", "row_id", (~C("covered")).cast("double").alias("missed")))
    out = adaptive_alpha(ordered(rows), SeriesKey(("fold",), "at", ("row_id",)), missed="missed")
    return out.select("fold", "row_id", rnd(C("alpha")).alias("alpha"), rnd(C("alpha_next")).alias("alpha_next"))


def ordered(df):
    """Row order as a time: one second per row id."""
    from pitspark.functions.timefn import from_micros

    return df.withColumn("at", from_micros(C("row_id") * 1_000_000))


_ECE = """WITH b AS (SELECT {by}, least((row_number() OVER (PARTITION BY {by} ORDER BY confidence, row_id) - 1) // greatest(1, count(*) OVER (PARTITION BY {by}) // 15), 14) AS bin,
             confidence, correct, count(*) OVER (PARTITION BY {by}) AS n FROM ({src})),
    g AS (SELECT {by}, bin, count(*) / any_value(n) * abs(avg(confidence) - avg(correct::INT)) AS e FROM b GROUP BY {by}, bin)"""
_TOP = "SELECT row_id, any_value(fold) AS fold, any_value(present) AS present, max(p) AS confidence, arg_max(class, (p, -class)) = any_value(label) AS correct FROM probs GROUP BY 1"


@query("adaptive_ece", f"{_ECE.format(by='fold', src=_TOP)} SELECT fold, round(sum(e), 6) AS ece FROM g GROUP BY 1", "probs")
def adaptive_ece(t: Tables):
    """Equal-mass calibration error of the top class."""
    rows = materialise(K.top_class(probs(t)).select("fold", "row_id", "confidence", "correct"))
    out = K.ece(rows, ["fold"], confidence="confidence", correct=C("correct"), tie="row_id")
    return out.select("fold", rnd(C("ece")).alias("ece"))


@query(
    "classwise_ece",
    _ECE.format(
        by="fold, class", src="SELECT row_id, fold, class, greatest(p, 1 - p) AS confidence, (p > 0.5) = (label = class) AS correct FROM probs"
    )
    + ", c AS (SELECT fold, class, sum(e) AS ece FROM g GROUP BY 1, 2) SELECT fold, round(avg(ece), 6) AS macro_ece, round(max(ece), 6) AS worst_ece FROM c GROUP BY 1",
    "probs",
)
def classwise_ece(t: Tables):
    """Macro mean and worst one-vs-rest calibration error."""
    rows = materialise(K.one_vs_rest(probs(t)).select("fold", "class", "row_id", "confidence", "correct"))
    e = K.ece(rows, ["fold", "class"], confidence="confidence", correct=C("correct"), tie="row_id")
    return e.groupBy("fold").agg(rnd(F.avg("ece")).alias("macro_ece"), rnd(F.max("ece")).alias("worst_ece"))


@query(
    "bucket_ece",
    _ECE.format(
        by="fold, bucket",
        src=f"SELECT *, unnest(['both', CASE WHEN present THEN 'present' ELSE 'absent' END]) AS bucket FROM ({_TOP})",
    )
    + " SELECT fold, bucket, round(sum(e), 6) AS ece FROM g GROUP BY 1, 2",
    "probs",
)
def bucket_ece(t: Tables):
    """Calibration error with news, without news and on both."""
    own = F.when(C("present"), "present").otherwise("absent")
    rows = K.top_class(probs(t)).select(
        "fold", "row_id", "confidence", "correct", F.explode(F.array(own, F.lit("both"))).alias("bucket")
    )
    e = K.ece(materialise(rows), ["fold", "bucket"], confidence="confidence", correct=C("correct"), tie="row_id")
    return e.select("fold", "bucket", rnd(C("ece")).alias("ece"))


@query("brier", "SELECT fold, round(avg((p - (class = label)::INT) ** 2), 6) AS brier FROM probs GROUP BY 1", "probs")
def brier(t: Tables):
    """Brier score over rows and classes."""
    return probs(t).groupBy("fold").agg(rnd(F.avg(K.brier(C("probs"), C("label")))).alias("brier"))


@query(
    "variance_multiplier",
    "SELECT symbol, bar_close, CASE WHEN rv IS NOT NULL THEN round(least(greatest(0.5 / sqrt(greatest(rv * rv, 1e-12)), 0), 1), 6) END AS multiplier FROM rv60",
    "rv60",
)
def variance_multiplier(t: Tables):
    """Multiplier from a variance, bounded to [0, 1]."""
    return rv60(t).select(
        "symbol", "bar_close", rnd(K.variance_multiplier(C("rv") * C("rv"), target=0.5)).alias("multiplier")
    )


@query("calibration_report")
def calibration_report(t: Tables):
    """Per fold: temperature from slice b; quantiles, coverage, errors, final
    adaptive level and disjointness of the slices on slice c."""
    s = materialise(t.scores)
    temp = materialise(K.fit_temperature(s.filter(C("slice") == "b"), ["fold"]))
    rows = materialise(K.with_scores(K.probabilities(s.filter(C("slice") == "c").join(temp, "fold"), C("temperature"))))
    q = K.fit_quantiles(rows, ["fold"])
    out = materialise(K.top_class(K.with_sets(rows, q, ["fold"])))
    top = K.ece(out, ["fold"], confidence="confidence", correct=C("correct"), tie="row_id")
    ovr = K.ece(K.one_vs_rest(out), ["fold", "class"], confidence="confidence", correct=C("correct"), tie="row_id")
    ovr = ovr.groupBy("fold").agg(F.avg("ece").alias("macro_ece"), F.max("ece").alias("worst_ece"))
    level = adaptive_alpha(
        ordered(out.select("fold", "row_id", (~C("covered")).cast("double").alias("missed"))),
        SeriesKey(("fold",), "at", ("row_id",)),
        missed="missed",
    )
    level = level.groupBy("fold").agg(F.max_by("alpha_next", "row_id").alias("final_alpha"), F.count(F.lit(1)).alias("n_replay"))
    overlap = s.groupBy("fold", "row_id").agg(F.count_distinct("slice").alias("k")).groupBy("fold").agg((F.max("k") == 1).alias("disjoint"))
    base = out.groupBy("fold").agg(
        F.avg(C("covered").cast("double")).alias("coverage"), F.avg(K.brier(C("probs"), C("label"))).alias("brier")
    )
    j = temp.join(base, "fold").join(top, "fold").join(ovr, "fold").join(level, "fold").join(overlap, "fold")
    num = ("temperature", "coverage", "brier", "ece", "macro_ece", "worst_ece", "final_alpha")
    return j.select("fold", *[rnd(C(c)).alias(c) for c in num], "n_replay", "disjoint")


