"""Wind, gait and receiver noise at the published constants, on records made by formula.

The tables at hand hold no second-by-second flight, no long accelerometer signal and no receiver at
rest, so these queries make such records in the plan itself; their SQL makes the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmeter.operators import accel, noise, wind
from trackmeter.plans.bench_queries import _shown_spirals, rounded

START = 1_600_000_000
#: metres east of the first bird, one bird each: bands from the same thermal to the far side of a country
EAST = (0, 800, 1500, 5000, 20000, 45000, 120000, 300000)
FLIGHT_S, THERMAL_S, LEG_S = 900, 100, 180
#: speed and stride frequency of a walker, one walker each
GAITS = ((0.1, 1.03), (0.6, 1.41), (1.1, 1.78), (1.6, 2.16), (2.2, 2.53), (3.2, 3.28))
WALK_S, RATE_HZ = 1300, 12
REST_S = 6000


def _of(values: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), at.cast("int"))


def flight(spark: SparkSession) -> DataFrame:
    """Birds that circle for 100 s in every 180, drifting with a wind that differs a little by bird and thermal."""
    dev, s = F.pmod("id", F.lit(len(EAST))), F.floor(F.col("id") / len(EAST))
    d = spark.range(FLIGHT_S * len(EAST)).select("id", dev.alias("dev"), s.alias("s"), F.pmod(s, F.lit(LEG_S)).alias("u"), F.floor(s / LEG_S).alias("k"))
    turn, radius = 2 * math.pi / 20, 9.0 * 20 / (2 * math.pi)
    up = F.col("u") < THERMAL_S
    x = F.when(up, radius * F.sin(turn * F.col("u"))).otherwise(9.0 * (F.col("u") - THERMAL_S)) + (2 + 0.25 * F.col("dev")) * F.col("s") + _of(EAST, F.col("dev"))
    y = F.when(up, radius * (1 - F.cos(turn * F.col("u")))).otherwise(0.0) + (1 - 0.1 * F.col("k")) * F.col("s")
    alt = F.when(up, 300 + 1.2 * F.col("u")).otherwise(420 - 1.5 * (F.col("u") - THERMAL_S)) + 10 * F.col("dev")
    return d.select(
        F.concat(F.lit("bird-"), F.col("dev")).alias("entity"), F.col("id").alias("event_id"), ((START + F.col("s") + 7 * F.col("dev")) * 1_000_000).cast("bigint").alias("ts_us"),
        (10 + y / 111195.0).alias("lat"), (20 + x / 109506.0).alias("lon"), alt.cast("double").alias("altitude_gps_m"),
    )


def walk(spark: SparkSession) -> DataFrame:
    """A second's samples a row: a stride of its own frequency for each speed, and an overtone."""
    dev, s = F.pmod("id", F.lit(len(GAITS))), F.floor(F.col("id") / len(GAITS))
    d = spark.range(WALK_S * len(GAITS)).select("id", dev.alias("dev"), s.alias("s"), _of(tuple(g[1] for g in GAITS), dev).alias("f"))
    at = lambda i: (F.col("s") * RATE_HZ + i) / RATE_HZ
    wave = F.transform(F.sequence(F.lit(0), F.lit(RATE_HZ - 1)), lambda i: 1 + 0.3 * F.sin(2 * math.pi * F.col("f") * at(i)) + 0.1 * F.sin(2 * math.pi * 4.9 * at(i)))
    return d.select(
        F.concat(F.lit("walker-"), F.col("dev")).alias("entity"), F.col("id").alias("event_id"), ((START + F.col("s")) * 1_000_000).cast("bigint").alias("ts_us"),
        wave.alias("signal"), _of(tuple(g[0] for g in GAITS), F.col("dev")).alias("v"),
    )


def rest(spark: SparkSession) -> DataFrame:
    """Three receivers, a fix a second: two side by side, one far off; noise from whole-number arithmetic."""
    dev, s = F.pmod("id", F.lit(3)), F.floor(F.col("id") / 3)
    wobble = lambda a, m: (F.pmod(F.col("id") * a, F.lit(m)) / m - 0.5) * 10
    x = wobble(7919, 1009) + F.when(dev == 2, 900.0).otherwise(40.0 * dev)
    d = spark.range(REST_S * 3)
    return d.select(
        F.concat(F.lit("receiver-"), dev).alias("entity"), F.col("id").alias("event_id"), ((START + s) * 1_000_000).cast("bigint").alias("ts_us"),
        (3 + wobble(104729, 997) / 111195.0).alias("lat"), (3 + x / 111195.0).alias("lon"),
        (F.pmod(F.col("id"), F.lit(37)) / 250.0).alias("speed_mps"), (2.0 + F.pmod(F.col("id"), F.lit(5))).alias("h_accuracy_m"),
    )


def planted_spirals(spark, d):
    """Spirals of at least 20 rates and 330 degrees, turning over 3 degrees a second."""
    return _shown_spirals(wind.spirals(flight(spark)))


def planted_wind_summary(spark, d):
    s = wind.wind_summary(wind.spirals(flight(spark)))
    return rounded(s, airspeed_p25=3, airspeed_p50=3, airspeed_p75=3, wind_p50=3, wind_p90=3, median_altitude_m=3, median_climb_mps=3)


def planted_wind_pairs(spark, d):
    """Spirals of two birds within 300 s and 2 km, which meet by time and place."""
    p = wind.spiral_pairs(wind.spirals(flight(spark)), km=2.0)
    return rounded(p.select("a_entity", "a_island", "b_entity", "b_island", "distance_km", "wind_gap"), distance_km=3, wind_gap=3)


def planted_wind_agreement(spark, d):
    return rounded(wind.agreement(wind.spiral_pairs(wind.spirals(flight(spark)), km=2.0)), median_gap=3, p75_gap=3, max_gap=3)


def planted_wind_structure(spark, d):
    return rounded(wind.structure_function(wind.spiral_pairs(wind.spirals(flight(spark)))), median_gap=3, p75_gap=3)


def planted_gaits(spark, d):
    """Frames of 96 samples with hop 48, more than 300 a class."""
    f = accel.spliced_frames(walk(spark), 96, 48).withColumn("class", accel.speed_class(F.col("v"))).filter("class is not null")
    return rounded(accel.mean_spectra(accel.spectra(f, ["entity", "stretch", "class"], 96), 96, float(RATE_HZ)), froude=4, stride_m=4)


def planted_transition(spark, d):
    """Gait classes on either side of the speed at which legs of 0.4 m change from walk to run."""
    g = accel.mean_spectra(accel.spectra(accel.spliced_frames(walk(spark), 96, 48).withColumn("class", accel.speed_class(F.col("v"))), ["entity", "stretch", "class"], 96), 96, float(RATE_HZ))
    run = F.get(F.array(*[F.lit(float(e)) for e in accel.SPEED_EDGES]), F.col("class")) >= accel.transition_speed()
    return g.select("class", run.alias("runs"), F.round(F.lit(accel.transition_speed()), 4).alias("transition_mps"))


def planted_still_windows(spark, d):
    """Windows of 60 s with at least 20 fixes under 0.10 m/s."""
    return rounded(noise.still_windows(rest(spark), 3.0, 3.0), sigma_m=4, vmax=4)


def planted_device_pairs(spark, d):
    """Receivers within 100 m in at least 5,000 common seconds."""
    return rounded(noise.device_pairs(rest(spark), 3.0, 3.0), dist_median_m=3, sigma_rel_m=3, sigma_each_m=3)


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("planted_")}
