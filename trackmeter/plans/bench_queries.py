"""Queries of the measuring bench, each over its whole tables.

Thresholds are the published ones unless the tables at hand cannot meet them; these are then named here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmeter.functions.geo import haversine_m, with_utm
from trackmeter.operators import accel, bursts, conformance, corpus, declare, export, fence, fleet, noise, sheets, wind
from trackmeter.operators.drift import headers, parsed
from trackmeter.operators.fixes import dated_records
from trackmeter.operators.packed import all_bursts
from trackmeter.operators.tracks import consecutive_pairs, first_per_second, gap_bursts, track_table, triplets, unmarked
from trackmeter.session import Written
from trackmeter.sources.tables import Tables

#: a park in metres of transverse Mercator about 3 degrees east, northern hemisphere
PARK = ((100_000.0, 100_000.0), (900_000.0, 50_000.0), (1_000_000.0, 700_000.0), (550_000.0, 420_000.0), (150_000.0, 900_000.0))
MERIDIAN = 3.0
CADENCES = (0, 1200, 3600, 7200, 10800, 21600, 43200, 86400)
ORIGIN = (3.0, 3.0)
#: still: under 0.5 m/s, in windows of 600 s with 5 fixes (devices here report too seldom for 20 a minute)
STILL = {"still_mps": 0.5, "window_s": 600, "least": 5}
#: spirals: one fix a second by rank, 3 rates (no device here reports every second)
DENSE = {"least_rates": 3}


def r(x: Column | str, n: int) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, n)


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _tracks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return track_table(Tables(spark, d).position_fixes, columns)


def _sound(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return unmarked(_tracks(spark, d, *columns, "x_manual_outlier"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pair table, written once: several measures read it, and plans stay short."""
    return Written(spark).put(fleet.intra_burst_pairs(_sound(spark, d)), "pairs")


def steps_by_device(spark, d):
    p = consecutive_pairs(_tracks(spark, d)).filter("dist_m is not null")
    return p.groupBy("entity").agg(F.count(F.lit(1)).alias("n_steps"), r(F.max("dist_m"), 3).alias("longest_m"), F.max("dt_s").alias("longest_s"))


def track_record(spark, d):
    cols = ("speed_mps", "heading_deg", "altitude_gps_m", "h_accuracy_m", "x_external_temp_c", "x_battery_mv", "x_tag_id", "x_manual_outlier", "x_visible", "sensor")
    return _tracks(spark, d, *cols)


def marked_and_hidden(spark, d):
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    t = _tracks(spark, d, "x_manual_outlier", "x_visible")
    return t.agg(
        F.count(F.lit(1)).alias("n"),
        n(F.col("x_manual_outlier")).alias("marked"),
        n(F.col("x_visible")).alias("visible"),
        n(~F.col("x_visible")).alias("hidden"),
    )


def spikes_by_device(spark, d):
    return corpus.spikes(corpus.sized(_tracks(spark, d), 50))


def spike_fixes(spark, d):
    return rounded(corpus.spike_fixes(_tracks(spark, d)), excursion_m=2)


def repeated_positions(spark, d):
    return corpus.repeated_positions(consecutive_pairs(_tracks(spark, d)), "entity")


def cadence_by_device(spark, d):
    return rounded(corpus.cadence(_tracks(spark, d), ["entity"]), gap_p05_s=6, gap_p95_s=6, regular_pct=6)


def cadence_of_fleet(spark, d):
    return rounded(corpus.cadence(_tracks(spark, d), round_to=-1), gap_p05_s=6, gap_p95_s=6, regular_pct=6)


def corpus_measure(spark, d):
    m = corpus.measure(Written(spark).put(_tracks(spark, d), "tracks"))
    return rounded(m, days=3, pct_repeated=6, pct_spikes=6, regular_pct=6, gap_p95_s=6, least_step_m=6)


def capabilities(spark, d):
    wanted = ["location-lat", "location-long", "ground-speed", "heading", "external-temperature", "eobs:battery-voltage", "eobs:temperature", "argos:lc"]
    return rounded(corpus.capabilities(Tables(spark, d).position_fixes, wanted), filled_pct=6)


def sensor_shares(spark, d):
    return rounded(corpus.category_shares(Tables(spark, d).position_fixes, "sensor-type"), share=6)


def argos_class_shares(spark, d):
    return rounded(corpus.category_shares(Tables(spark, d).position_fixes, "argos:lc"), share=6)


def fleet_health(spark, d):
    return rounded(fleet.fleet_health(_pairs(spark, d), Tables(spark, d).tag_reference), share_pct=6)


def fleet_summary(spark, d):
    return rounded(fleet.fleet_summary(_pairs(spark, d)), pct=6, median_jump_m=3, p99_jump_m=3, max_jump_m=3)


def fleet_by_batch(spark, d):
    t = Tables(spark, d)
    return rounded(fleet.by_batch(fleet.fleet_health(_pairs(spark, d), t.tag_reference)), min=6, median=6, max=6)


def rates_by_rank(spark, d):
    return rounded(fleet.rate(_pairs(spark, d), "start_rank"), share_pct=6)


def rates_by_rank_from_end(spark, d):
    return rounded(fleet.rate(_pairs(spark, d), "from_end"), share_pct=6)


def rates_by_batch_and_size(spark, d):
    p = fleet.pivot_batch_size(_pairs(spark, d), Tables(spark, d).tag_reference)
    return p.select("batch", *[x for k in (2, 3, 4, 5, 6) for x in (r(F.col(f"{k}_pct"), 6).alias(f"pct_{k}"), F.col(f"{k}_n").alias(f"n_{k}"))])


def rates_by_year(spark, d):
    return rounded(fleet.by_year(_pairs(spark, d), Tables(spark, d).tag_reference), share_pct=6)


def first_fix_delays(spark, d):
    """Wake period and window are those of the cadences here: 300 s, from an hour early to a day late."""
    return fleet.first_fix_delays(_pairs(spark, d), Tables(spark, d).tag_reference, 300, -3600, 86400)


def flagged_fixes(spark, d):
    return fleet.flagged_fixes(_pairs(spark, d), "start")


def flagged_fixes_second(spark, d):
    return fleet.flagged_fixes(_pairs(spark, d), "end")


def four_fix_bursts(spark, d):
    return rounded(fleet.four_fix_bursts(_sound(spark, d), _pairs(spark, d)), fix1_m=3, fix2_m=3)


def subsampling(spark, d):
    s = fleet.subsampling(_sound(spark, d), _pairs(spark, d))
    return rounded(s, max_jump_m=3, first_pair_share_pct=6, contaminated_share_pct=6, blanket_remedy_pct=6, targeted_remedy_pct=6)


def speed_gate(spark, d):
    return fleet.speed_gate(consecutive_pairs(_sound(spark, d)))


def burst_sizes(spark, d):
    b = gap_bursts(_tracks(spark, d)).filter("rank = 0")
    return b.groupBy(F.col("size").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("bursts"))


def burst_features(spark, d):
    return rounded(bursts.burst_features(_sound(spark, d)), v_mps=3, resid_m=3, path_m=2, chord_m=2)


def rest_and_move(spark, d):
    return rounded(bursts.rest_and_move(bursts.burst_features(_sound(spark, d))), resid_rest_m=3, resid_move_m=3, v_move_mps=3, tortuosity=3)


def gap_segments(spark, d):
    b = gap_bursts(_tracks(spark, d), 6 * 3600)
    return b.groupBy("entity").agg(F.max("island").alias("segments"), F.max("size").cast("bigint").alias("longest"))


def _in_park(spark, d, *columns):
    """Every fix, with NULL where the projection does not hold."""
    t = with_utm(_tracks(spark, d, *columns), MERIDIAN, south=False)
    return t.withColumn("inside", fence.in_polygon(F.col("e"), F.col("n"), PARK))


def utm_positions(spark, d):
    return _in_park(spark, d).select("event_id", r("e", 1).alias("east"), r("n", 1).alias("north"))


def fence_inside(spark, d):
    return rounded(fence.inside_share(_in_park(spark, d)), inside_pct=6)


def fence_crossings(spark, d):
    return rounded(fence.crossings(_in_park(spark, d), CADENCES), pct_of_native=6)


def _fenced(spark, d):
    p = _in_park(spark, d, "x_visible").filter("x_visible")
    flags = fleet.flagged_fixes(_pairs(spark, d)).select("event_id").distinct().withColumn("f", F.lit(True))
    p = p.join(flags, "event_id", "left").withColumn("flagged", F.coalesce("f", F.lit(False)))
    p = p.withColumn("d_m", F.when(~F.col("inside"), fence.ring_distance(F.col("e"), F.col("n"), PARK)))
    return Written(spark).put(p.select("entity", "event_id", "ts_us", "inside", "flagged", "d_m"), "fenced")


def fence_excursions(spark, d):
    return rounded(fence.excursions(_fenced(spark, d)), max_d_m=1)


def fence_rates(spark, d):
    return rounded(fence.outside_rates(_fenced(spark, d)), rate=8, low=8, high=8)


def fence_summary(spark, d):
    return rounded(fence.excursion_summary(fence.excursions(_fenced(spark, d))), top_share=6, q75_max_d_m=1)


def _windows(spark, d):
    return noise.still_windows(_tracks(spark, d, "speed_mps", "h_accuracy_m"), *ORIGIN, **STILL)


def still_windows(spark, d):
    return rounded(_windows(spark, d), sigma_m=3, vmax=4)


def noise_by_device(spark, d):
    return rounded(noise.noise_by_device(_windows(spark, d)), sigma_median_m=3, sigma_p90_m=3, ratio=3)


def declared_accuracy(spark, d):
    return rounded(noise.declared_against_measured(_windows(spark, d)), sigma_m=3, sigma_p90_m=3, ratio=3)


def declared_rank_correlation(spark, d):
    return rounded(noise.declared_rank_correlation(rounded(_windows(spark, d), sigma_m=6)), rho=4)


def constant_fields(spark, d):
    return noise.constant_fields(_tracks(spark, d, "sensor", "argos_lc", "x_type_of_fix"), ["sensor", "argos_lc", "x_type_of_fix"])


def battery_days(spark, d):
    return noise.battery_days(_tracks(spark, d, "x_battery_mv", "x_fix_battery_mv"))


def battery_slopes(spark, d):
    days = noise.battery_days(_tracks(spark, d, "x_battery_mv", "x_fix_battery_mv"))
    return rounded(noise.battery_slopes(days), sag_slope=4, rest_slope=4)


def device_pairs(spark, d):
    """Devices within 2,000 km at the same second, at least 3 such seconds (elsewhere 5,000 within 100 m)."""
    p = noise.device_pairs(_tracks(spark, d), *ORIGIN, near_m=2e6, least=3)
    return rounded(p, dist_median_m=1, sigma_rel_m=1, sigma_each_m=1)


def _samples(spark, d):
    """Samples of every burst however written, with device and time."""
    acc = Tables(spark, d).acc_records
    v = all_bursts(acc).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    whole = F.element_at("v", -1)["pos"] == F.size("v")  # a missing place would shift the axes
    v = v.filter(whole).select("event_id", accel.samples(F.transform("v", lambda x: x["value"])).alias("xyz"))
    return dated_records(acc).join(v, "event_id")


def acc_features(spark, d):
    f = accel.burst_features(_samples(spark, d)).drop("xyz", "ts_us")
    return rounded(f, **{c: 3 for c in f.columns if c not in ("event_id", "entity", "n_samples")})


def acc_resting(spark, d):
    rest = accel.resting(accel.burst_features(_samples(spark, d)))
    return rest.groupBy("entity").agg(F.count(F.lit(1)).alias("bursts"))


def _calibration(spark, d):
    return accel.calibrate(accel.burst_features(_samples(spark, d)), least=20)


def acc_calibration(spark, d):
    return rounded(_calibration(spark, d), off_x=1, off_y=1, off_z=1, counts_per_g=1, residual_pct=2)


def acc_calibration_spread(spark, d):
    c = accel.calibration_spread(_calibration(spark, d))
    return rounded(c, **{x: 2 for x in c.columns if x != "units"})


def gait_table(spark, d):
    """Frames of 8 samples with hop 4 (bursts here are short) of the joined stretches, speeds within the same minute's fix."""
    sig = accel.gait_signal(_samples(spark, d), _calibration(spark, d))
    v = _tracks(spark, d, "speed_mps").withColumn("minute", F.floor(F.col("ts_us") / 60e6)).groupBy("entity", "minute").agg(F.avg("speed_mps").alias("v"))
    sig = sig.withColumn("minute", F.floor(F.col("ts_us") / 60e6)).join(v, ["entity", "minute"], "left")
    sig = Written(spark).put(sig.select("entity", "event_id", "ts_us", "signal", "v"), "signal")  # splicing reads it several times
    f = accel.spliced_frames(sig, 8, 4).withColumn("class", accel.speed_class(F.col("v"))).filter("class is not null")
    m = accel.mean_spectra(accel.spectra(f, ["entity", "stretch", "class"], 8), 8, 12.0, least=10)
    return rounded(m, froude=4, stride_m=4)


def speed_at_bursts(spark, d):
    t = Tables(spark, d)
    s = accel.speed_at(dated_records(t.acc_records), _tracks(spark, d, "speed_mps"))
    return s.groupBy("entity").agg(F.count(F.lit(1)).alias("bursts"), F.count("speed_mps").alias("with_speed"))


def burst_stretches(spark, d):
    s = accel.stretches(dated_records(Tables(spark, d).acc_records))
    runs = s.groupBy("entity", "stretch").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("entity").agg(F.count(F.lit(1)).alias("stretches"), F.max("n").alias("longest"))


def _dense(spark, d):
    """The rank of a fix stands for its second, so that steps are one second each; movement is shrunk
    tenfold, so that speeds are those of flight."""
    t = _tracks(spark, d, "altitude_gps_m")
    g = gap_bursts(t, 1e12, ["altitude_gps_m"])
    small = [(F.col(c) / 10).alias(c) for c in ("lat", "lon")]
    return Written(spark).put(g.select("entity", "event_id", "ts_us", *small, "altitude_gps_m", F.col("rank").cast("bigint").alias("t")), "dense")


def _spirals(spark, d):
    return Written(spark).put(wind.spirals(_dense(spark, d), **DENSE), "spirals")


def turn_rates(spark, d):
    t = wind.turn_rates(_dense(spark, d)).filter("rate is not null")
    return t.groupBy("entity").agg(F.count(F.lit(1)).alias("rates"), F.sum((F.abs("rate") > 3).cast("int")).alias("turning"))


def _shown_spirals(s):
    return rounded(s, wind_east=4, wind_north=4, wind=4, airspeed=4, lat=6, lon=6, altitude_m=3, climb_mps=4, wind_from_deg=3)


def wind_spirals(spark, d):
    return _shown_spirals(_spirals(spark, d))


def wind_summary(spark, d):
    s = wind.wind_summary(_spirals(spark, d))
    return rounded(s, airspeed_p25=3, airspeed_p50=3, airspeed_p75=3, wind_p50=3, wind_p90=3, median_altitude_m=3, median_climb_mps=3)


def _spiral_pairs(spark, d):
    return wind.spiral_pairs(_spirals(spark, d), span_s=30)


def wind_pairs(spark, d):
    p = wind.same_thermal(_spiral_pairs(spark, d), 20.0)
    return p.select("a_entity", "a_island", "b_entity", "b_island", r("distance_km", 3).alias("distance_km"), r("wind_gap", 3).alias("wind_gap"))


def wind_structure(spark, d):
    return rounded(wind.structure_function(_spiral_pairs(spark, d)), median_gap=3, p75_gap=3)


def declaration_scan(spark, d):
    return declare.scan(Tables(spark, d).documents)


def declaration_passages(spark, d):
    s = declare.scan(Tables(spark, d).documents, with_passages=True)
    return s.filter("says_repetition or says_truncation or says_spikes").select("doc_id", "passages_repetition", "passages_truncation", "passages_spikes")


def parsed_sheets(spark, d):
    """Measures read back from the text of quality sheets."""
    t = Tables(spark, d).documents.filter("source = 'quality_sheet' and text is not null")
    get = lambda name, rx, kind: F.regexp_extract("text", rf"\| {name} \| ({rx})", 1).try_cast(kind)
    return t.select(
        "doc_id",
        "uuid",
        get("Repeated positions", r"[0-9.]+", "double").alias("pct_repeated"),
        get("Position spikes", r"[0-9.]+", "double").alias("pct_spikes"),
        get("Coordinate grain", "[0-9]+", "int").alias("decimals_lat"),
        get("Fixes", "[0-9]+", "bigint").alias("n_fixes"),
        get("Individuals", "[0-9]+", "bigint").alias("n_individuals"),
    )


def declaration_rates(spark, d):
    """Deposits whose sheets show a property, against the others: does their own text mention it?"""
    q = parsed_sheets(spark, d).filter("uuid is not null").groupBy("uuid").agg(
        F.max("pct_repeated").alias("pct_repeated"), F.max("pct_spikes").alias("pct_spikes"), F.min("decimals_lat").alias("decimals_lat")
    )
    docs = Tables(spark, d).documents.select("doc_id", "uuid")
    said = declare.scan(Tables(spark, d).documents)
    flags = [c for c in said.columns if c.startswith(("says_", "template_"))]
    by = said.join(docs, "doc_id").filter("uuid is not null").groupBy("uuid").agg(*[F.max(c).alias(c) for c in flags])
    c = declare.case_control(declare.properties(q).join(by, "uuid"), list(declare.FAMILIES))
    return rounded(c, rate_case=6, low_case=6, high_case=6, rate_control=6, low_control=6, high_control=6)


def detector_validation(spark, d):
    """Spike rates of Argos devices against GPS devices; a device's sensor is its most frequent."""
    t = _tracks(spark, d, "sensor")
    n = t.groupBy("entity", F.lower("sensor").alias("sensor")).agg(F.count(F.lit(1)).alias("n"))
    main = n.groupBy("entity").agg(F.max(F.struct("n", "sensor"))["sensor"].alias("sensor"))
    q = corpus.spikes(corpus.sized(t, 50)).withColumn("pct_spikes", 100 * F.col("spikes") / F.col("triplets"))
    return rounded(corpus.detector_validation(q.join(main, "entity")), z=4)


def inventory(spark, d):
    return corpus.inventory(Tables(spark, d).deposits).drop("description")


def inventory_totals(spark, d):
    return corpus.inventory_totals(corpus.inventory(Tables(spark, d).deposits))


def inventory_usable(spark, d):
    return corpus.usable(corpus.inventory(Tables(spark, d).deposits)).select("uuid", "mb")


def inventory_largest(spark, d):
    """The 25 largest deposits (a top-k report)."""
    return corpus.largest(corpus.inventory(Tables(spark, d).deposits), 25).select("uuid", "mb", "year")


def inventory_largest_recent(spark, d):
    """The 15 largest deposits since 2020 (a top-k report)."""
    return corpus.largest(corpus.inventory(Tables(spark, d).deposits), 15, 2020).select("uuid", "mb", "year")


def inventory_files(spark, d):
    return corpus.files_by_suffix(Tables(spark, d).deposits)


def _device_quality(spark, d, grain=False):
    """``grain``: median decimals and least step; without it the greatest decimals, as the SQL of sheet_readings has it."""
    t = _tracks(spark, d)
    t = Written(spark).put(t, "tracks")
    sp = corpus.spikes(t).select("entity", (100 * F.col("spikes") / F.col("triplets")).alias("pct_spikes"))
    rep = corpus.repeated_positions(consecutive_pairs(t), "entity").select("entity", (100 * F.col("repeats") / F.col("steps")).alias("pct_repeated"))
    dec = t.groupBy("entity").agg(F.max(corpus.decimals(corpus.plain_number(F.col("lat")))).alias("decimals_lat"), F.lit(None).cast("double").alias("least_step_m"))
    pace = corpus.cadence(t, ["entity"])
    if grain:
        dec = corpus.grain_by_device(t)
    return dec.join(rep, "entity", "left").join(sp, "entity", "left").join(pace, "entity", "left")


def sheet_readings(spark, d):
    q = sheets.readings(_device_quality(spark, d))
    return q.select("entity", "read_spikes", "read_repeats", sheets.duration_text(F.col("gap_mode_s")).alias("pace"), F.size("limits").alias("n_limits"))


def sheet_grains(spark, d):
    """The grain of each device as its sheet reads it: median decimals, least step of latitude."""
    q = sheets.readings(_device_quality(spark, d, grain=True))
    return q.select("entity", "decimals_lat", r("least_step_m", 3).alias("least_step_m"), "read_grain", F.size("limits").alias("n_limits"), F.array_join("limits", "; ").alias("limit_texts"))


def most_affected(spark, d):
    """The 15 devices with the highest spike rate (a top-k report)."""
    return corpus.most_affected(_device_quality(spark, d)).select("entity", r("pct_spikes", 6).alias("pct_spikes"))


def spike_rate_spread(spark, d):
    s = corpus.rate_spread(_device_quality(spark, d), "pct_spikes")
    return rounded(s, p25=6, p50=6, p75=6, max=6)


def quality_sheets(spark, d):
    """One Markdown sheet a device."""
    n = _tracks(spark, d).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_fixes"), F.lit(1).alias("n_individuals"), ((F.max("ts_us") - F.min("ts_us")) / 86_400e6).alias("days")
    )
    s = _tracks(spark, d, "sensor").groupBy("entity", F.lower("sensor").alias("sensor")).agg(F.count(F.lit(1)).alias("k"))
    s = s.groupBy("entity").agg(F.max(F.when(F.col("sensor").isNotNull(), F.struct("k", "sensor")))["sensor"].alias("sensor"))
    return sheets.sheet_text(_device_quality(spark, d, grain=True).join(n, "entity").join(s, "entity", "left"), "entity").select("entity", "sheet")


def device_rules(spark, d):
    return conformance.device_rules(track_table(Tables(spark, d).position_fixes, ("lat", "lon", "speed_mps"), positioned=False))


def _file_conformance(spark, d):
    t = Tables(spark, d)
    heads = headers(t.export_lines, t.field_dictionary)
    return conformance.file_report(t.export_lines, parsed(t.export_lines, heads), heads, t.export_files)


def file_conformance(spark, d):
    return _file_conformance(spark, d).drop("detail")


def conformance_counts(spark, d):
    return conformance.status_counts(_file_conformance(spark, d))


def conformance_causes(spark, d):
    """The three most frequent causes of each status (a top-k report)."""
    return conformance.top_causes(_file_conformance(spark, d))


def guard_flag_total(spark, d):
    """Flags summed by device and by rank, from two plans; refused if they differ."""
    p = _pairs(spark, d)
    a = fleet.rate(p, "entity").agg(F.sum("flagged").alias("by_device"))
    b = fleet.rate(p, "start_rank").agg(F.sum("flagged").alias("by_rank"))
    same = F.assert_true(F.col("by_device") == F.col("by_rank"), "the flag totals differ")
    return a.crossJoin(b).filter(same.isNull())  # one row each


def _flagged_points(spark, d):
    flags = fleet.flagged_fixes(_pairs(spark, d)).select("event_id").distinct().withColumn("f", F.lit(True))
    t = _tracks(spark, d, "x_visible").filter("x_visible")
    return export.points(t.join(flags, "event_id", "left").withColumn("flagged", F.coalesce("f", F.lit(False))))


def export_points(spark, d):
    return _flagged_points(spark, d).drop("ts_us", "rank")


def _shown_lines(layer):
    """The geometry by its digest: every vertex counts."""
    return rounded(layer.withColumn("wkt_md5", F.md5("wkt")).drop("wkt"), dur_h=4, pct_flag=4)


def export_tracks(spark, d):
    return _shown_lines(export.tracks_layer(_flagged_points(spark, d)))


def export_day_paths(spark, d):
    return _shown_lines(export.day_paths(_flagged_points(spark, d)))


def export_geojson(spark, d):
    return export.geojson(rounded(export.tracks_layer(_flagged_points(spark, d)), dur_h=4, pct_flag=4)).select("entity", "seg", "part", "feature")


def triplet_excursions(spark, d):
    t = triplets(_tracks(spark, d)).filter("excursion_m is not null")
    return t.groupBy("entity").agg(F.count(F.lit(1)).alias("triplets"), r(F.max("excursion_m"), 2).alias("greatest_m"))


def seconds_deduplicated(spark, d):
    return first_per_second(_tracks(spark, d)).groupBy("entity").agg(F.count(F.lit(1)).alias("seconds"))


def devices_near_start(spark, d):
    """Distance of each device's first fix from the origin of local metres (great circle)."""
    f = _tracks(spark, d).groupBy("entity").agg(F.min(F.struct("ts_us", "event_id", "lat", "lon")).alias("f"))
    return f.select("entity", r(haversine_m("f.lat", "f.lon", F.lit(ORIGIN[0]), F.lit(ORIGIN[1])), 2).alias("metres"))


def tag_batches(spark, d):
    return fleet.batches(Tables(spark, d).tag_reference)


def devices_without_fixes(spark, d):
    """Animals with acceleration bursts but no placed fix (an anti-join)."""
    acc = dated_records(Tables(spark, d).acc_records).select("entity").distinct()
    return acc.join(_tracks(spark, d).select("entity").distinct(), "entity", "left_anti")


_HELPERS = {"r", "rounded"}
QUERIES = {k: f for k, f in list(globals().items()) if getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _HELPERS}
