"""Drift detection and retraining rules as DataFrame jobs.

PSI and KS work on any number of groups at once (a ``group`` column such as
a day or a model): rows are binned or counted per group in one distributed
aggregate, and only the small per-group tables are ordered.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.operators.scale import in_ranges

EPS = 1e-6


def _bin_edges(mn: float, mx: float, bins: int) -> list[float]:
    """Smallest double of each bin after the first, so that cutting at the
    edges equals ``floor((value - mn) / width)`` bit for bit."""
    width, out = (mx - mn) / bins, []
    for k in range(1, bins):
        e = mn + k * width
        while (e - mn) / width < k:
            e = np.nextafter(e, np.inf)
        while (np.nextafter(e, -np.inf) - mn) / width >= k:
            e = np.nextafter(e, -np.inf)
        out.append(float(e))
    return out


def _extents(cols: Sequence[str], weight: Column) -> list[Column]:
    return [f for i, c in enumerate(cols) for f in (
        F.min(F.col(c).cast("double")).alias(f"mn{i}"), F.max(F.col(c).cast("double")).alias(f"mx{i}"),
        F.coalesce(F.sum(F.when(F.col(c).isNotNull(), weight)), F.lit(0)).alias(f"n{i}"))]


def psi(base: DataFrame, cur: DataFrame, cols: Sequence[str], bins: int = 10,
        group: Sequence[str] = (), base_weight: str | None = None) -> DataFrame:
    """PSI per feature, or per (group, feature) of ``cur`` against the one
    baseline. Ten equal-width bins over the joint min/max, last bin closed;
    proportions + 1e-6; natural log. A constant feature or an empty side gives
    0; rows without a group are left out. ``base_weight`` names a row-count
    column when the baseline is given pre-aggregated (value, count).

    The baseline is counted once, cut at the bin edges of all groups; each
    group then adds up its pieces. Only groups x features x bins numbers (days
    or models, not rows) pass through the driver."""
    g = list(group)
    w = F.col(base_weight).cast("long") if base_weight else F.lit(1).cast("long")
    for c in g:
        cur = cur.where(F.col(c).isNotNull())
    b = base.agg(*_extents(cols, w)).first()
    groups = cur.groupBy(*g).agg(*_extents(cols, F.lit(1).cast("long"))).collect()
    ranges = []   # (group values, feature, baseline rows, current rows, min, max, edges)
    for r in groups:
        for i in range(len(cols)):
            ends = [x for x in (b[f"mn{i}"], b[f"mx{i}"], r[f"mn{i}"], r[f"mx{i}"]) if x is not None]
            mn, mx = (min(ends), max(ends)) if ends else (0.0, 0.0)
            edges = _bin_edges(mn, mx, bins) if mx > mn else []
            ranges.append(([r[c] for c in g], i, b[f"n{i}"], r[f"n{i}"], mn, mx, edges))
    cuts = [sorted({e for r in ranges if r[1] == i for e in r[6]}) for i in range(len(cols))]

    values = base.select(w.alias("w"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    pieces = Bucketizer(splitsArray=[[-np.inf, *(c or [0.0]), np.inf] for c in cuts], handleInvalid="keep",
                        inputCols=[f"v{i}" for i in range(len(cols))],
                        outputCols=[f"p{i}" for i in range(len(cols))]).transform(values)
    counted = (pieces.select("w", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"p{i}").cast("int").alias("p"),
                                                               F.col(f"v{i}").alias("v")) for i in range(len(cols))])).alias("x"))
               .where("x.v is not null").groupBy("x.i", "x.p").agg(F.sum("w").alias("n")).collect())
    below = [np.zeros(len(c) + 2, dtype=np.int64) for c in cuts]   # rows before piece p
    for r in counted:
        if r["p"] <= len(cuts[r["i"]]):
            below[r["i"]][r["p"] + 1] = r["n"]
    below = [np.cumsum(x) for x in below]

    def base_bins(i, edges, mn, mx):
        at = [0, *(below[i][np.searchsorted(cuts[i], e) + 1] for e in edges), below[i][len(cuts[i]) + 1]]
        return [int(x) for x in np.diff(at)] if edges else [0] * bins

    schema = T.StructType([*[cur.schema[c] for c in g], *[T.StructField(n, t) for n, t in (
        ("fi", T.IntegerType()), ("feature", T.StringType()), ("nb", T.LongType()), ("nc", T.LongType()),
        ("mn", T.DoubleType()), ("mx", T.DoubleType()), ("cb", T.ArrayType(T.LongType())))]])
    grid = cur.sparkSession.createDataFrame(
        [(*key, i, cols[i], nb, nc, mn, mx, base_bins(i, edges, mn, mx)) for key, i, nb, nc, mn, mx, edges in ranges], schema)
    now = (cur.select(*g, F.explode(F.array(*[F.struct(F.lit(i).alias("fi"), F.col(c).cast("double").alias("value"))
                                              for i, c in enumerate(cols)])).alias("x"))
           .select(*g, "x.fi", "x.value").where("value is not null"))
    # the grid has one row per group and feature
    now = now.join(F.broadcast(grid.where("mx > mn").select(*g, "fi", "mn", "mx")), [*g, "fi"])
    width = (F.col("mx") - F.col("mn")) / bins
    now = (now.withColumn("bin", F.least(F.floor((F.col("value") - F.col("mn")) / width), F.lit(bins - 1)).cast("int"))
           .groupBy(*g, "fi").agg(*[F.count_if(F.col("bin") == k).alias(f"c{k}") for k in range(bins)]))
    full = grid.join(now, [*g, "fi"], "left")
    term = F.lit(0.0)
    for k in range(bins):
        pb = F.try_divide(F.col("cb")[k], F.col("nb")) + EPS
        pc = F.try_divide(F.coalesce(F.col(f"c{k}"), F.lit(0)), F.col("nc")) + EPS
        term = term + (pc - pb) * F.log(pc / pb)
    none = (F.col("nb") == 0) | (F.col("nc") == 0) | (F.col("mx") == F.col("mn"))
    return full.select(*g, "fi", "feature", F.round(F.when(none, 0.0).otherwise(term), 9).alias("psi"))


def _running(df: DataFrame, keys: Sequence[str], value: str, n: str, out: str) -> DataFrame:
    """``out``: sum of ``n`` up to and with each row, in order of ``value`` per
    key, without a window over a whole key: rows are dealt into equal-sized
    ranges, whose totals are cumulated (one row per key and range)."""
    d = in_ranges(df, [*keys, value])
    tot = d.groupBy(*keys, "_b").agg(F.sum(n).alias("_s"))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(tot, [*keys, "_b"]).withColumn(out, F.col("_o") + F.sum(n).over(inside)).drop("_b", "_o")


def ks_two_sample(base: DataFrame, cur: DataFrame, col: str, group: Sequence[str] = (),
                  base_weight: str | None = None) -> DataFrame:
    """R2: two-sample KS statistic, or one per group of ``cur`` against the one
    baseline — the largest gap between the two empirical CDFs (0 when a side
    is empty; rows without a group are left out).

    Between two neighbouring current values the current CDF stands still and
    the baseline's rises, so the gap is largest just before or at a current
    value: baseline ranks are worked out once, at every value of either side,
    and looked up by value. The baseline is never copied per group.
    """
    g = list(group)
    bw = F.col(base_weight).cast("long") if base_weight else F.lit(1).cast("long")
    v = F.col(col).cast("double").alias("v")
    b = base.select(v, bw.alias("nb_v")).where("v is not null")
    c = cur.select(*g, v).where(" and ".join(f"`{x}` is not null" for x in [*g, "v"]))
    c = c.groupBy(*g, "v").agg(F.count(F.lit(1)).alias("nc_v"))
    ranks = _running(b.unionByName(c.select("v", F.lit(0).cast("long").alias("nb_v"))).groupBy("v").agg(F.sum("nb_v").alias("nb_v")),
                     [], "v", "nb_v", "cb")
    nb = F.coalesce(ranks.agg(F.sum("nb_v")).scalar(), F.lit(0))
    c = _running(c, g, "v", "nc_v", "cc").join(ranks, "v")
    per = c.groupBy(*g).agg(F.sum("nc_v").alias("nc")) if g else None
    c = c.join(F.broadcast(per), g) if g else c.withColumn("nc", c.agg(F.sum("nc_v")).scalar())   # one row per group
    nb = F.when(nb > 0, nb)
    gap = F.greatest(F.abs(F.col("cb") / nb - F.col("cc") / F.col("nc")),
                     F.abs((F.col("cb") - F.col("nb_v")) / nb - (F.col("cc") - F.col("nc_v")) / F.col("nc")))
    return c.groupBy(*g).agg(F.max(gap).alias("ks")).select(*g, F.round(F.coalesce("ks", F.lit(0.0)), 9).alias("ks"))


def metric_decay(base: Column, cur: Column) -> Column:
    """Relative decay (base − cur) / base; 0 when base <= 0."""
    return F.when(base > 0, (base - cur) / base).otherwise(F.lit(0.0))


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def pair_features(base: DataFrame, cur: DataFrame, exclude: Sequence[str] = ()) -> list[tuple[str, bool, bool]]:
    """(feature, in the baseline, in the current set) for every numeric
    column of either side but those in ``exclude``: the baseline's in its order,
    then those that only the current set has. A column that is numeric on one
    side only does not pair."""
    def numeric(df):
        return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]
    b, c = numeric(base), numeric(cur)
    return [(f, True, f in c) for f in b] + [(f, False, True) for f in c if f not in b]


def paired_psi(base: DataFrame, cur: DataFrame, exclude: Sequence[str] = (), **options) -> DataFrame:
    """J10 + R1: feature, in_baseline, in_current and psi of the features that
    both sets have (null for the others, which take no part in the mean)."""
    pairs = pair_features(base, cur, exclude)
    shared = [f for f, b, c in pairs if b and c]
    names = base.sparkSession.createDataFrame(pairs, "feature string, in_baseline boolean, in_current boolean")
    if not shared:
        return names.withColumn("psi", F.lit(None).cast("double"))
    return names.join(psi(base, cur, shared, **options).select("feature", "psi"), "feature", "left")


def drift_report(psi_df: DataFrame, ks_df: DataFrame, metrics: DataFrame, group: Sequence[str] = (),
                 feature_threshold: float = 0.2, prediction_threshold: float = 0.05,
                 decay_threshold: float = 0.1) -> DataFrame:
    """R4 (+J10): per group — mean PSI over shared features, KS, business
    metric decay, reasons and the retraining flag.

    ``metrics`` has (group…, metric_baseline, metric_current)."""
    g = list(group) or ["_g"]
    if not group:  # one implicit group: every join stays an equi-join
        psi_df, ks_df, metrics = (d.withColumn("_g", F.lit(0)) for d in (psi_df, ks_df, metrics))
    feat = psi_df.groupBy(*g).agg(
        F.avg("psi").alias("feature_drift_score"),
        F.sort_array(F.collect_list(F.when(F.col("psi") > feature_threshold, F.struct(
            F.col("fi").alias("fi"),
            F.format_string("Feature '%s' PSI=%.3f exceeds threshold", F.col("feature"), F.col("psi"))
            .alias("msg"))))).alias("_fr"))
    if group:
        rep = feat.join(ks_df, g, "inner").join(metrics, g, "inner")
    else:   # single rows: scalars instead of joins
        rep = (feat.withColumn("ks", ks_df.select("ks").scalar())
               .withColumn("metric_baseline", metrics.select("metric_baseline").scalar())
               .withColumn("metric_current", metrics.select("metric_current").scalar()))
    decay = metric_decay(F.col("metric_baseline"), F.col("metric_current"))
    reasons = F.concat(
        F.transform("_fr", lambda s: s["msg"]),
        F.filter(F.array(
            F.when(F.col("ks") > prediction_threshold,
                   F.format_string("Prediction drift KS=%.3f exceeds threshold", F.col("ks"))),
            F.when(decay > decay_threshold,
                   F.format_string("Business metric decayed %.1f%% (from %.4f to %.4f)", decay * 100,
                                   F.col("metric_baseline"), F.col("metric_current")))),
            lambda x: x.isNotNull()))
    out = rep.select(*g, F.round("feature_drift_score", 9).alias("feature_drift_score"),
                     F.col("ks").alias("prediction_drift_score"),
                     "metric_baseline", "metric_current", F.round(decay, 9).alias("relative_decay"),
                     reasons.alias("reasons"), (F.size(reasons) > 0).alias("needs_retraining"))
    return out if group else out.drop("_g")


def retrain_decision(signals: DataFrame, min_interactions: int = 10_000, max_days: int = 14,
                     critical_decay: float = 0.2) -> DataFrame:
    """Priority (critical / high / normal / skip), reasons and decision
    per row of a signals table with columns relative_decay, needs_retraining,
    reasons, days_since_training, new_interactions. A critical row is never
    held back for volume when choosing priority, but ``should_retrain``
    still needs enough data (``blocked_by_volume`` marks that case)."""
    decay, drift = F.col("relative_decay"), F.col("needs_retraining")
    days, new = F.col("days_since_training"), F.col("new_interactions")
    critical = F.col("metric_baseline") > 0
    critical = critical & (decay > critical_decay)
    p1 = F.when(critical, "critical").otherwise("skip")
    p2 = F.when(drift & (p1 != "critical"), F.when(days > 7, "high").otherwise("normal")).otherwise(p1)
    p3 = F.when((days >= max_days) & (p2 == "skip"), "normal").otherwise(p2)
    enough = new >= min_interactions
    p4 = F.when(~enough & p3.isin("normal", "skip"), "skip").otherwise(p3)
    reasons = F.concat(
        F.filter(F.array(F.when(critical, F.format_string(
            "Critical business metric decay: %.1f%% (threshold: %.0f%%)", decay * 100, F.lit(critical_decay * 100)))),
            lambda x: x.isNotNull()),
        F.when(drift, F.col("reasons")).otherwise(F.array().cast("array<string>")),
        F.filter(F.array(
            F.when(days >= max_days, F.format_string("Model stale: %d days since last training (max: %d)",
                                                     days, F.lit(max_days))),
            F.when(~enough & (p3 != "critical"), F.format_string(
                "Insufficient new data: %d/%d interactions (waiting for more data)", new, F.lit(min_interactions)))),
            lambda x: x.isNotNull()))
    should = p4.isin("critical", "high", "normal") & enough
    return (signals.withColumn("priority", p4).withColumn("trigger_reasons", reasons)
            .withColumn("should_retrain", should)
            .withColumn("blocked_by_volume", p4.isin("critical", "high", "normal") & ~enough))


# FIXED VALUES: training configuration per retraining priority.
RETRAIN_CONFIGS = (
    ("critical", 15, 5e-4, 512, 500, True, True),
    ("high", 10, 1e-3, 512, 200, True, True),
    ("default", 5, 1e-3, 256, 100, False, False),
)


def retrain_config(decisions: DataFrame) -> DataFrame:
    """Attach the training configuration for each decision's priority
    (a 3-row lookup table: broadcast is size-proven)."""
    spark = decisions.sparkSession
    cfg = spark.createDataFrame(list(RETRAIN_CONFIGS), "cfg_key string, epochs int, learning_rate double, "
                                "batch_size int, warmup_steps int, use_full_dataset boolean, run_extended_eval boolean")
    key = F.when(F.col("priority").isin("critical", "high"), F.col("priority")).otherwise("default")
    return decisions.withColumn("cfg_key", key).join(F.broadcast(cfg), "cfg_key", "left").drop("cfg_key")


def retrain_short(signals: DataFrame, max_days: int = 14) -> DataFrame:
    """Drift → immediate, stale → scheduled, else none."""
    return signals.withColumn("decision", F.when(F.col("needs_retraining"), "trigger_immediate_retrain")
                              .when(F.col("days_since_training") >= max_days, "trigger_scheduled_retrain")
                              .otherwise("no_retrain_needed"))
