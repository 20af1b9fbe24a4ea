"""Accelerometer bursts: samples, features, calibration on a sphere, gait spectra."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.operators.fixes import BLOCK_US, block_window, blocks_window, in_blocks, with_neighbours
from trackmeter.operators.quantile import summary_quantiles
from trackmeter.operators.tracks import first_per_second, islands, seconds

STANDARD_GRAVITY = 9.80665
#: left-closed speed classes, m/s
SPEED_EDGES = (0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 7.0)


def samples(values: Column, least: int = 3) -> Column:
    """Interleaved X Y Z to an array of struct(x, y, z); NULL under ``least`` whole samples. A cut last sample is dropped."""
    n = F.floor(F.size(values) / 3).cast("int")
    at = lambda i, k: F.get(values, i * 3 + k).cast("double")
    xyz = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("z")))
    return F.when(n >= least, xyz)


def text_samples(raw: Column, least: int = 3) -> Column:
    """Samples of space-separated text; NULL if any value is no number."""
    v = F.transform(F.split(F.trim(raw), " +"), lambda s: s.try_cast("double"))
    return F.when(~F.exists(v, lambda x: x.isNull()), samples(v, least))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def burst_features(bursts: DataFrame, xyz: str = "xyz") -> DataFrame:
    """Adds ``n_samples``, means and population deviations per axis, and the mean norms about the mean and about zero.

    Array functions on the row: no explosion, no shuffle. Rows without samples are left out.
    """
    d = bursts.filter(F.col(xyz).isNotNull()).withColumn("n_samples", F.size(xyz))
    axis = lambda k: F.transform(xyz, lambda s: s[k])
    d = d.withColumns({f"a{k}_mean": _mean(axis(k)) for k in "xyz"})
    dev = lambda k: F.sqrt(_mean(F.transform(xyz, lambda s: (s[k] - F.col(f"a{k}_mean")) * (s[k] - F.col(f"a{k}_mean")))))
    norm = lambda off: _mean(F.transform(xyz, lambda s: F.sqrt(sum((s[k] - off(k)) * (s[k] - off(k)) for k in "xyz"))))
    return d.withColumns(
        {f"a{k}_std": dev(k) for k in "xyz"} | {"norm_mean": norm(lambda k: F.col(f"a{k}_mean")), "norm_abs_mean": norm(lambda k: F.lit(0.0))}
    )


def resting(features: DataFrame, quantile: float = 0.25) -> DataFrame:
    """Bursts whose greatest axis deviation is at most the fleet's own quantile of it."""
    agitation = F.greatest("ax_std", "ay_std", "az_std")
    limit = summary_quantiles(features, {"_limit": (agitation, quantile)})  # one row
    return features.crossJoin(F.broadcast(limit)).filter(agitation <= F.col("_limit")).drop("_limit")


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in pdf.itertuples(index=False):
        s = {k: getattr(r, k) for k in pdf.columns}
        m = np.array(
            [
                [4 * s["xx"], 4 * s["xy"], 4 * s["xz"], 2 * s["x"]],
                [4 * s["xy"], 4 * s["yy"], 4 * s["yz"], 2 * s["y"]],
                [4 * s["xz"], 4 * s["yz"], 4 * s["zz"], 2 * s["z"]],
                [2 * s["x"], 2 * s["y"], 2 * s["z"], s["n"]],
            ]
        )
        v = np.array([2 * s["xq"], 2 * s["yq"], 2 * s["zq"], s["q"]])
        c = np.linalg.lstsq(m, v, rcond=None)[0]
        radius = math.sqrt(max(c[3] + c[0] ** 2 + c[1] ** 2 + c[2] ** 2, 1e-9))
        out.append((s["entity"], int(s["n"]), c[0] + s["mx"], c[1] + s["my"], c[2] + s["mz"], radius))
    return pd.DataFrame(out, columns=["entity", "n_bursts", "off_x", "off_y", "off_z", "counts_per_g"])


def calibrate(features: DataFrame, least: int = 500) -> DataFrame:
    """``entity, n_bursts, off_x, off_y, off_z, counts_per_g, residual_pct`` by a sphere through the axis means.

    Centred moment sums by device, then a 4 x 4 solve on one row a device; the residual is a second pass.
    """
    c = features.groupBy("entity").agg(*[F.avg(f"a{k}_mean").alias(f"m{k}") for k in "xyz"], F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= least)
    d = features.join(c.drop("_c"), "entity").withColumns({k: F.col(f"a{k}_mean") - F.col(f"m{k}") for k in "xyz"})
    q = sum(F.col(k) * F.col(k) for k in "xyz")
    sums = {k: F.sum(k) for k in "xyz"} | {a + b: F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    sums |= {"q": F.sum(q)} | {k + "q": F.sum(F.col(k) * q) for k in "xyz"} | {f"m{k}": F.max(f"m{k}") for k in "xyz"}
    m = d.groupBy("entity").agg(F.count(F.lit(1)).cast("double").alias("n"), *[e.cast("double").alias(k) for k, e in sums.items()])
    schema = "entity string, n_bursts bigint, off_x double, off_y double, off_z double, counts_per_g double"
    fit = m.mapInPandas(lambda it: map(_solve, it), schema)
    rho = F.sqrt(sum((F.col(f"a{k}_mean") - F.col(f"off_{k}")) * (F.col(f"a{k}_mean") - F.col(f"off_{k}")) for k in "xyz"))
    res = features.join(fit, "entity").groupBy("entity").agg((100 * F.stddev_pop(rho) / F.max("counts_per_g")).alias("residual_pct"))
    return fit.join(res, "entity")


def calibration_spread(cal: DataFrame) -> DataFrame:
    """Least, median, greatest gain, their spread in percent, and the worst error of one gain for all."""
    g = F.col("counts_per_g")
    q = summary_quantiles(cal, {"median_gain": (g, 0.5)})
    ends = cal.agg(F.count(F.lit(1)).alias("units"), F.min(g).alias("min_gain"), F.max(g).alias("max_gain"), *[(F.max(f"off_{k}") - F.min(f"off_{k}")).alias(f"range_{k}") for k in "xyz"])
    d = ends.join(q, how="left")  # one row each
    worst = F.greatest(F.abs(F.col("max_gain") - F.col("median_gain")), F.abs(F.col("min_gain") - F.col("median_gain")))
    return d.withColumns(
        {"spread_pct": F.try_divide(100 * (F.col("max_gain") - F.col("min_gain")), "median_gain"), "pooling_error_pct": F.try_divide(100 * worst, "median_gain")}
    )


def speed_class(v: Column) -> Column:
    """Index of the left-closed class; NULL below 0, from the last edge on, and for NULL."""
    c = F.when(v < 0, None)
    for i, top in enumerate(SPEED_EDGES[1:]):
        c = c.when(v < top, i)
    return c


def _in_stretches(bursts: DataFrame, payload: list[str], block_us: int) -> DataFrame:
    d = with_neighbours(in_blocks(first_per_second(bursts), ["tsec", *payload], block_us), ["tsec"], before=1)
    return islands(d, F.col("p1_tsec").isNull() | (F.col("tsec") - F.col("p1_tsec") != 1))


def stretches(bursts: DataFrame) -> DataFrame:
    """``entity, event_id, ts_us, tsec, stretch``: bursts of one device at consecutive seconds share a stretch; one burst a second."""
    d = _in_stretches(bursts, [], BLOCK_US)
    return d.select("entity", "event_id", "ts_us", "tsec", F.col("island").alias("stretch"))


def spliced_frames(bursts: DataFrame, size: int = 96, hop: int = 48, block_us: int = BLOCK_US) -> DataFrame:
    """``entity, stretch, frame, seg, v``: overlapping windows of the joined ``signal`` of each stretch; a short rest is dropped.

    The bursts of a stretch are laid end to end, so a frame may span several; ``v`` is the mean of their
    speeds ``v``, without those that are null. A burst without a signal is no burst: a stretch ends there.
    Places in the signal are running sums within blocks of time, with one row a block for what came
    before; only the parts of one frame meet, never a whole stretch.
    """
    d = _in_stretches(bursts.filter(F.size("signal") > 0), ["signal", "v"], block_us)
    w = block_window("ts_us", "event_id")
    d = d.withColumn("_n", F.size("signal")).withColumn("_c", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("_b", F.when(F.col("rank") == 0, F.col("_c")))
    before = blocks_window().rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy("entity", "blk").agg(F.sum("_n").alias("_all"), F.max("_b").alias("_last"))
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    blocks = blocks.select("entity", "blk", "_off", F.last(F.col("_last") + F.col("_off"), True).over(before).alias("_prev"))
    begin = F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_begin", begin).join(blocks, ["entity", "blk"])
    d = d.withColumn("_at", F.col("_off") + F.col("_c") - F.coalesce(F.col("_begin") + F.col("_off"), "_prev"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / hop)).cast("bigint")
    last = F.floor((F.col("_at") + F.col("_n") - 1) / hop).cast("bigint")
    parts = d.filter(first <= last).select("entity", F.col("island").alias("stretch"), "signal", "v", "_n", "_at", F.explode(F.sequence(first, last)).alias("frame"))
    start = F.greatest(F.lit(0), F.col("frame") * hop - F.col("_at")).cast("int")
    end = F.least(F.col("_n"), F.col("frame") * hop + size - F.col("_at")).cast("int")
    parts = parts.withColumns({"_s": start, "_e": end}).filter("_e > _s")
    part = F.struct("_at", F.slice("signal", F.col("_s") + 1, F.col("_e") - F.col("_s")).alias("x"))
    f = parts.groupBy("entity", "stretch", "frame").agg(F.flatten(F.array_sort(F.collect_list(part))["x"]).alias("seg"), F.avg("v").alias("v"))
    return f.filter(F.size("seg") == size)


def frames(signal: DataFrame, keys: list[str], size: int = 96, hop: int = 48) -> DataFrame:
    """``keys, frame, seg``: overlapping windows of each row's array ``signal``; a short rest is dropped."""
    n = F.floor((F.size("signal") - size) / hop).cast("int")
    d = signal.filter(F.size("signal") >= size).select(*keys, "signal", F.explode(F.sequence(F.lit(0), n)).alias("frame"))
    return d.select(*keys, "frame", F.slice("signal", F.col("frame") * hop + 1, size).alias("seg"))


def spectra(framed: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Adds ``power``: the normalised power of each Hann-windowed frame, by FFT in Arrow batches; flat frames are left out."""
    schema = framed.select(*keys, "frame").schema
    window = np.hanning(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seg = np.array(pdf["seg"].tolist(), dtype=float).reshape(len(pdf), size)
            seg = seg - seg.mean(axis=1, keepdims=True)
            keep = seg.std(axis=1) >= 1e-6
            p = np.abs(np.fft.rfft(seg[keep] * window, axis=1)) ** 2
            p = p / p.sum(axis=1, keepdims=True)
            out = pdf.loc[keep, [*keys, "frame"]].copy()
            out["power"] = pd.Series(list(p), index=out.index, dtype=object)
            yield out

    from pyspark.sql.types import ArrayType, DoubleType

    return framed.select(*keys, "frame", "seg").mapInPandas(run, schema.add("power", ArrayType(DoubleType())))


def mean_spectra(powers: DataFrame, size: int, rate_hz: float, low_hz: float = 0.8, high_hz: float = 5.5, leg_m: float = 0.40, least: int = 300) -> DataFrame:
    """``class, n, stride_hz, froude, stride_m``: the strongest frequency of each speed class's mean spectrum.

    Of equal powers the lowest frequency counts. Classes with at most ``least`` frames have none.
    """
    d = powers.filter("class is not null").select("class", F.posexplode("power").alias("k", "p"))
    m = d.groupBy("class", "k").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))
    hz = F.col("k") * (rate_hz / size)
    band = F.when((hz >= low_hz) & (hz <= high_hz), F.struct("p", (-F.col("k")).alias("k")))
    best = m.groupBy("class").agg(F.max("n").alias("n"), F.max(band).alias("b"))
    edges = F.array(*[F.lit(float(e)) for e in SPEED_EDGES])
    centre = (F.get(edges, F.col("class")) + F.get(edges, F.col("class") + 1)) / 2
    stride = F.when(F.col("n") > least, -F.col("b.k") * (rate_hz / size))
    return best.select(
        "class",
        "n",
        stride.alias("stride_hz"),
        (centre * centre / (STANDARD_GRAVITY * leg_m)).alias("froude"),
        F.try_divide(centre, stride).alias("stride_m"),
    )


def gait_signal(acc: DataFrame, cal: DataFrame, xyz: str = "xyz") -> DataFrame:
    """Adds ``signal``: the norm of each sample in g; devices without calibration drop out."""
    d = acc.filter(F.col(xyz).isNotNull()).join(cal.select("entity", "off_x", "off_y", "off_z", "counts_per_g"), "entity")
    part = lambda s, k: (s[k] - F.col(f"off_{k}")) / F.col("counts_per_g")
    norm = F.transform(xyz, lambda s: F.sqrt(sum(part(s, k) * part(s, k) for k in "xyz")))
    return d.withColumn("signal", norm)


def speed_at(bursts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds the Doppler speed of the same device and second, NULL where there is none (an equi-join)."""
    v = first_per_second(tracks).select("entity", "tsec", "speed_mps")
    return bursts.withColumn("tsec", seconds("ts_us")).join(v, ["entity", "tsec"], "left")


def transition_speed(leg_m: float = 0.40, froude: float = 0.5) -> float:
    return math.sqrt(froude * STANDARD_GRAVITY * leg_m)
