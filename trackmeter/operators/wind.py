"""Wind from circling flight: turning runs, spirals, and how far spirals of different devices agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmeter.functions.columns import settled
from trackmeter.functions.geo import EARTH_RADIUS_M, heading_deg, wrap_180
from trackmeter.operators.corpus import sized
from trackmeter.operators.fixes import in_blocks, with_neighbours
from trackmeter.operators.quantile import summary_quantiles
from trackmeter.operators.spatial import Grid
from trackmeter.operators.tracks import islands, seconds
from trackmeter.session import Written

PAYLOAD = ["lat", "lon", "altitude_gps_m", "t"]


def turn_rates(tracks: DataFrame, least_fixes: int = 100) -> DataFrame:
    """Each fix with velocity into it (``vx, vy``, m/s), the step ``dt`` and the turn rate since the step before.

    ``t`` is the second of a fix: the whole second of its time, unless the input has a column ``t``.
    """
    d = tracks if "t" in tracks.columns else tracks.withColumn("t", seconds("ts_us"))
    d = sized(d, least_fixes)
    n = with_neighbours(in_blocks(d, PAYLOAD), PAYLOAD, before=2)
    east = lambda a, b: F.radians(F.col(f"{b}lon") - F.col(f"{a}lon")) * EARTH_RADIUS_M * F.cos(F.radians(f"{a}lat"))
    north = lambda a, b: F.radians(F.col(f"{b}lat") - F.col(f"{a}lat")) * EARTH_RADIUS_M
    dt = lambda a, b: F.col(f"{b}t") - F.col(f"{a}t")
    v = {
        "vx": F.try_divide(east("p1_", ""), dt("p1_", "")),
        "vy": F.try_divide(north("p1_", ""), dt("p1_", "")),
        "_ux": F.try_divide(east("p2_", "p1_"), dt("p2_", "p1_")),
        "_uy": F.try_divide(north("p2_", "p1_"), dt("p2_", "p1_")),
        "dt": dt("p1_", ""),
    }
    d = settled(n, v)
    turn = wrap_180(F.degrees(F.atan2("vx", "vy")) - F.degrees(F.atan2("_ux", "_uy")))
    rate = F.when((F.col("dt") > 0) & F.col("_ux").isNotNull(), turn / F.col("dt"))
    return d.withColumn("rate", rate)


def spirals(
    tracks: DataFrame, rate_deg_s: float = 3.0, least_rates: int = 20, least_turn: float = 330.0, least_fixes: int = 100
) -> DataFrame:
    """Runs of steady turning through at least about a full circle, and the wind they drift with.

    A run holds consecutive fixes turning faster than ``rate_deg_s`` in one direction, at steps of one
    second; it starts at the fix after its first velocity. Wind: the mean ground velocity (velocities
    before each turn, so the first may span a gap); airspeed: the mean speed against it. Runs whose wind
    is 40 m/s or more, or airspeed outside 2 to 30 m/s, are left out.
    """
    d = Written(tracks.sparkSession).put(turn_rates(tracks, least_fixes), "rates")
    turning = F.coalesce((F.abs("rate") > rate_deg_s) & (F.col("dt") == 1), F.lit(False))
    d = d.withColumn("turning", turning).withColumn("way", F.signum("rate"))
    n = with_neighbours(
        d.select("entity", "blk", "ts_us", "event_id", "lat", "lon", "altitude_gps_m", "t", "rate", "turning", "way", "_ux", "_uy", "p1_lat", "p1_lon", "p1_altitude_gps_m", "p1_t"),
        ["way"],
        before=1,
    )
    r = islands(n, ~F.col("turning") | F.col("p1_way").isNull() | (F.col("way") != F.col("p1_way")))
    at = lambda c: F.struct("ts_us", "event_id", F.col(c).alias("v"))
    first = lambda c: F.min(at(c))["v"]
    last = lambda c: F.max(at(c))["v"]
    runs = r.filter("turning")
    g = runs.groupBy("entity", "island").agg(
        F.count(F.lit(1)).alias("n_rates"),
        F.sum("rate").alias("turned"),
        F.avg("_ux").alias("wind_east"),
        F.avg("_uy").alias("wind_north"),
        first("p1_t").alias("start_s"),
        F.max(at("p1_t"))["v"].alias("end_s"),
        F.avg("p1_lat").alias("lat"),
        F.avg("p1_lon").alias("lon"),
        F.avg("p1_altitude_gps_m").alias("altitude_m"),
        (last("p1_altitude_gps_m") - first("p1_altitude_gps_m")).alias("_climb"),
    )
    g = g.filter((F.col("n_rates") >= least_rates) & (F.abs("turned") >= least_turn) & (F.col("end_s") > F.col("start_s")))
    air = runs.join(g.select("entity", "island", "wind_east", "wind_north"), ["entity", "island"]).groupBy("entity", "island").agg(
        F.avg(F.hypot(F.col("_ux") - F.col("wind_east"), F.col("_uy") - F.col("wind_north"))).alias("airspeed")
    )
    wind = F.hypot("wind_east", "wind_north")
    out = g.join(air, ["entity", "island"]).withColumns(
        {
            "wind": wind,
            "wind_from_deg": heading_deg("wind_east", "wind_north"),
            "duration_s": F.col("end_s") - F.col("start_s"),
            "climb_mps": F.col("_climb") / (F.col("end_s") - F.col("start_s")),
        }
    )
    return out.filter((F.col("wind") < 40) & F.col("airspeed").between(2, 30)).drop("_climb", "turned")


def pairs_within(
    items: DataFrame, time: str = "start_s", span: float = 300, device: str = "entity", condition: Column | None = None, metres: float | None = None
) -> DataFrame:
    """Rows of different devices at most ``span`` apart in time, earlier first (``a_*``, ``b_*``).

    Interval join by buckets as long as the span: the earlier row is sent to its own bucket and the
    next, the later to its own only, so every pair meets exactly once in an equi-join. Equal times go by
    device. With ``metres``, rows (``lat, lon``) meet only within cells of about that size: the earlier
    is sent to the cells its disc touches. Use it where far pairs are not wanted, as they grow with the square.
    """
    k = F.floor(F.col(time) / span)
    side = lambda p: items.select(*[F.col(c).alias(f"{p}_{c}") for c in items.columns], k.alias("_k"))
    a = side("a").withColumn("_k", F.explode(F.array(F.col("_k"), F.col("_k") + 1)))
    b, keys = side("b"), ["_k"]
    if metres is not None:
        grid, keys = Grid(metres, 2.0), ["_k", "node"]
        at = lambda d, p: d.withColumns({"lat": F.col(f"{p}_lat"), "lon": F.col(f"{p}_lon")})
        a, b = grid.discs(at(a, "a")).drop("lat", "lon"), grid.points(at(b, "b")).drop("lat", "lon")
    ta, tb = F.col(f"a_{time}"), F.col(f"b_{time}")
    da, db = F.col(f"a_{device}"), F.col(f"b_{device}")
    later = (tb > ta) | ((tb == ta) & (db > da))
    cond = (da != db) & later & (tb - ta <= span)
    if condition is not None:
        cond = cond & condition
    return a.join(b, keys).filter(cond).drop(*keys)


def spiral_pairs(sp: DataFrame, span_s: float = 300, altitude_m: float = 300, km: float | None = None) -> DataFrame:
    """Pairs of spirals of different devices near in time and altitude, with distance and disagreement of wind.

    With ``km``, only pairs within that distance are formed (the structure function needs all).
    """
    cols = ["entity", "island", "start_s", "lat", "lon", "altitude_m", "wind_east", "wind_north", "wind"]
    low = F.abs(F.col("a_altitude_m") - F.col("b_altitude_m")) < altitude_m
    # the plane distance below departs from the great circle by far less than the margin
    p = pairs_within(sp.select(*cols), span=span_s, condition=low, metres=None if km is None else km * 1020.0)
    dx = F.radians(F.col("b_lon") - F.col("a_lon")) * EARTH_RADIUS_M * F.cos(F.radians("a_lat"))
    dy = F.radians(F.col("b_lat") - F.col("a_lat")) * EARTH_RADIUS_M
    p = p.withColumns(
        {
            "distance_km": F.hypot(dx, dy) / 1000,
            "wind_gap": F.hypot(F.col("a_wind_east") - F.col("b_wind_east"), F.col("a_wind_north") - F.col("b_wind_north")),
        }
    )
    return p if km is None else p.filter(F.col("distance_km") < km)


def agreement(pairs: DataFrame) -> DataFrame:
    """``n_pairs, median_gap, p75_gap, max_gap``: how far the winds of two devices disagree."""
    q = summary_quantiles(pairs, {"median_gap": (F.col("wind_gap"), 0.5), "p75_gap": (F.col("wind_gap"), 0.75)})
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.max("wind_gap").alias("max_gap")).join(q, how="left")  # one row each


def same_thermal(pairs: DataFrame, km: float = 2.0) -> DataFrame:
    return pairs.filter(F.col("distance_km") < km)


def structure_function(pairs: DataFrame) -> DataFrame:
    """``d_min_km, n_pairs, median_gap, p75_gap`` by band of distance (left-closed: 0, 2, 10, 50, 200 km)."""
    d = F.col("distance_km")
    band = F.when(d < 2, 0).when(d < 10, 2).when(d < 50, 10).when(d < 200, 50).otherwise(200)
    b = pairs.withColumn("d_min_km", band)
    n = b.groupBy("d_min_km").agg(F.count(F.lit(1)).alias("n_pairs"))
    return n.join(summary_quantiles(b, {"median_gap": (F.col("wind_gap"), 0.5), "p75_gap": (F.col("wind_gap"), 0.75)}, ["d_min_km"]), "d_min_km")


def wind_summary(sp: DataFrame) -> DataFrame:
    c = F.col
    q = summary_quantiles(
        sp,
        {
            "median_duration_s": (c("duration_s"), 0.5),
            "airspeed_p25": (c("airspeed"), 0.25),
            "airspeed_p50": (c("airspeed"), 0.5),
            "airspeed_p75": (c("airspeed"), 0.75),
            "wind_p50": (c("wind"), 0.5),
            "wind_p90": (c("wind"), 0.9),
            "median_altitude_m": (c("altitude_m"), 0.5),
            "median_climb_mps": (c("climb_mps"), 0.5),
        },
    )
    return sp.agg(F.count(F.lit(1)).alias("n_spirals"), F.countDistinct("entity").alias("n_devices")).join(q, how="left")  # one row each
