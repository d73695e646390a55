"""Metrics, selections, audit, feed, match and sinks on literal values."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from priorline import messages
from priorline.functions.rows import with_residuals
from priorline.functions.text import match_text
from priorline.operators import audit, match, metrics, reports
from priorline.operators.quantiles import exact_quantiles
from priorline.operators.requests import validate_requests
from priorline.operators.slices import equal_counts, with_part
from priorline.plans.clean import clean_all
from priorline.sources import feed
from priorline.sources.files import discover_files, read_incident_files
from priorline.sources.tables import read_cleaned, read_split, write_cleaned, write_report, write_splits


def test_quantiles_sort_only_the_buckets_of_the_ranks(spark):
    """Null groups, negative values, ties and a group of one; few values reach the second pass."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("g"),
        F.when(F.col("id") % 5 == 0, 0.0).when(F.col("id") % 5 == 1, -((F.col("id") * 7919) % 1000) / 8.0)
        .otherwise(((F.col("id") * 104729) % 100_003) / 16.0).alias("v"),
    ).union(spark.createDataFrame([("one", 3.5), ("none", None)], "g string, v double"))
    wanted = {"q0": 0, "q10": 0.1, "q50": 0.5, "q95": 0.95, "q100": 1}
    got = {tuple(r)[0]: tuple(r)[1:] for r in exact_quantiles(df.repartition(5), ["g"], "v", wanted).collect()}
    con = duckdb.connect()
    t = df.toPandas()  # noqa: F841
    t["v"] = t["v"].astype(float)
    want = con.execute(
        "select g, " + ", ".join(f"quantile_cont(v, {q})" for q in wanted.values()) + " from t where not isnan(v) and v is not null group by g"
    ).fetchall()
    assert got == {line[0]: line[1:] for line in want} and None in got and "none" not in got


def test_rank_metrics_of_close_scores(spark):
    """Scores within a millionth are still spread over slices, and ties count half."""
    n = 5000
    df = spark.range(n).select(
        (F.lit(0.5) + (F.col("id") * 7 % 2500) / F.lit(2.5e9)).alias("p"), (F.col("id") * 31 % 7 < 3).cast("int").alias("y"),
        (F.col("id") % 2).alias("g"),
    )
    lines = df.collect()
    got = {r.g: r for r in metrics.rank_metrics(df, ["g"], "y", "p").collect()}
    for g in (0, 1):
        scores = sorted(((r.p, r.y) for r in lines if r.g == g), reverse=True)
        below, wins, positives, shown, hits, precision = 0, 0.0, 0, 0, 0, 0.0
        by_score = {}
        for p, y in scores:
            by_score.setdefault(p, [0, 0])[y] += 1
        for p in sorted(by_score, reverse=True):
            neg, pos = by_score[p]
            wins += neg * (positives + pos / 2)
            positives += pos
            shown += neg + pos
            hits += pos
            precision += pos * hits / shown
            below += neg
        assert abs(got[g].roc_auc - wins / (positives * below)) < 1e-12
        assert abs(got[g].pr_auc - precision / positives) < 1e-12
    histogram = df.select((-F.col("p")).alias("v")).distinct()
    bounds = sorted(set(equal_counts(histogram, "v", 32)))
    sizes = [r["count"] for r in with_part(histogram, "v", bounds, "part").groupBy("part").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * 2500 / 32


def test_exact_quantiles(spark):
    random.seed(3)
    values = [(g, random.choice([0.0, -1.5, random.uniform(-5, 900)])) for g in "aab" for _ in range(301)] + [("a", None)]
    df = spark.createDataFrame(values, "g string, v double")
    got = exact_quantiles(df, ["g"], "v", {"q0": 0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1})
    con = duckdb.connect()
    con.register("t", df.toPandas())
    expected = con.execute(
        "select g, " + ", ".join(f"quantile_cont(v, {q})" for q in (0, 0.25, 0.5, 0.9, 1)) + " from t group by g order by g"
    ).fetchall()
    for a, b in zip(got.orderBy("g").collect(), expected):
        assert a["g"] == b[0] and list(a)[1:] == pytest.approx(list(b)[1:])


def test_rank_metrics_equal_pair_counting(spark):
    random.seed(5)
    pairs = [(random.randint(0, 1), round(random.random(), 1)) for _ in range(300)]
    got = metrics.rank_metrics(spark.createDataFrame(pairs, "y int, p double"), [], "y", "p").first()
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for cut in sorted({p for _, p in pairs}, reverse=True):
        hits = sum(a >= cut for a in pos)
        ap += (hits - seen) / len(pos) * hits / sum(p >= cut for _, p in pairs)
        seen = hits
    assert (got["roc_auc"], got["pr_auc"]) == (pytest.approx(auc), pytest.approx(ap))


def test_one_class_has_no_rank_metrics(spark):
    got = metrics.rank_metrics(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double"), [], "y", "p").first()
    assert got["roc_auc"] is None and got["pr_auc"] is None


def test_calibration_error_and_bins(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (1, 0.6), (0, 0.9)], "y int, p double")
    assert metrics.expected_calibration_error(df, [], "y", "p", 2).first()[0] == pytest.approx(0.25)
    bins = metrics.reliability_bins(df, [], "y", "p", 10).orderBy("bin_lower").collect()
    # The seventh edge is the double 0.6000000000000001, so 0.6 lies in the bin below it.
    assert [b["row_count"] for b in bins] == [0, 1, 0, 0, 1, 1, 0, 0, 0, 1]


def test_cutoff_prefers_recall(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.25), (0, 0.15), (0, 0.05)], "y int, p double")
    best = metrics.pick_cutoff(metrics.cutoff_table(df, [], "y", "p"), []).first()
    assert (best["probability_cutoff"], best["met_min_recall"]) == (0.2, True)


def test_calibration_choice(spark):
    df = spark.createDataFrame(
        [("t", "uncalibrated", 0.1010, 0.05, 0.5), ("t", "sigmoid", 0.1005, 0.04, 0.5), ("t", "isotonic", 0.1, 0.02, 0.5)],
        "threshold string, calibration_method string, brier_score double, expected_calibration_error double, pr_auc double",
    )
    assert metrics.pick_calibration(df, ["threshold"]).first()["calibration_method"] == "isotonic"


def test_residual_reports(spark):
    df = with_residuals(
        spark.createDataFrame(
            [("test", "bus", 10.0, 10.5), ("test", "bus", 20.0, 19.5), ("test", "streetcar", 33.0, 20.0), ("test", "streetcar", 40.0, 20.0)],
            "split string, mode string, actual double, prediction double",
        )
    )
    groups = {r["mode"]: r for r in reports.error_by_group(df, "mode").collect()}
    assert groups["bus"]["mae"] == 0.5
    high = {r["threshold_minutes"]: r for r in reports.high_delay(df).collect()}
    assert (high[30]["actual_high_delay_rows"], high[30]["average_underprediction_amount"]) == (2, 16.5)
    assert high[60]["actual_high_delay_rows"] == 0 and high[60]["mae_high_delay"] is None


def test_threshold_counts_with_missing_mode(spark):
    df = spark.createDataFrame([("bus", 0.0), ("bus", 300.0), (None, 500.0), ("streetcar", 5.0)], "mode string, min_delay double")
    got = {(r["scope"], r["mode"], r["threshold_minutes"]): (r["count"], r["percentage"]) for r in reports.threshold_counts(df).collect()}
    assert got["overall", "all", 0] == (1, 25.0) and got["overall", "all", 240] == (2, 50.0)
    assert got["mode", "<NA>", 480] == (1, 100.0)


def test_audit_reasons(spark):
    df = spark.createDataFrame(
        [("bus", "29", "N", "Mechanical", "Main St"), ("bus", "Queen Station", "mechanical delay", "501", "29")],
        "mode string, route string, direction string, incident string, location string",
    )
    bad = {(r["column"], r["value"]): r for r in audit.suspicious_values(df).collect()}
    assert bad["route", "Queen Station"]["reasons"].startswith("long route value; many-word route value; looks like a location")
    assert bad["direction", "mechanical delay"]["reasons"] == "longer than 3 characters; contains incident or location word"
    assert bad["incident", "501"]["looks_like_fields"] == "route" and bad["location", "29"]["looks_like_fields"] == "route"


def test_location_match(spark):
    known = spark.createDataFrame([(v,) for v in ["QUEEN STREET AND SPADINA AVENUE", "KING STREET", "UNION STATION"]], "location string")
    asked = spark.createDataFrame([(v,) for v in ["Queen and Spadina", "king st", "Mars Base", "", None]], "location string")
    one = {r["location"]: r for r in match.match_locations(asked, known).collect()}
    assert (one["king st"]["match_type"], one["king st"]["score"]) == ("exact", 100.0)
    assert (one["Queen and Spadina"]["score"], one["Queen and Spadina"]["accepted_for_prediction"]) == (85.0, False)
    assert one["Mars Base"]["match_type"] == "none" and one[""]["warning"].startswith("Location is empty")
    nothing = match.match_locations(asked, known.limit(0)).where("location = 'Mars Base'").first()
    assert nothing["warning"] == messages.NO_KNOWN_LOCATION


def test_location_match_against_all_pairs(spark):
    rng = random.Random(1)
    words = ["queen", "st", "king", "and", "of", "a", "at", "bay", "union", "main", "stmain", "w"]
    texts = lambda n: sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n)})
    known, asked = texts(60), texts(80)
    got = match.match_locations(
        spark.createDataFrame([(v,) for v in asked], "location string"), spark.createDataFrame([(v,) for v in known], "location string")
    ).collect()
    plain = dict(spark.createDataFrame([(v,) for v in {*known, *asked}], "location string").select("location", match_text(F.col("location"))).collect())

    def score(one, other):
        if one == other:
            return 100.0
        if one in other or other in one:
            return max(80.0, 100.0 * min(len(one), len(other)) / max(len(one), len(other)))
        x, y = set(one.split()), set(other.split())
        weighty = x - set(match.STOPWORDS)
        return 85.0 if weighty and weighty <= y else 200.0 * len(x & y) / (len(x) + len(y))

    for row in got:
        best = max(score(plain[row.location], plain[k]) for k in known)
        assert row.score == round(best, 1) or abs(row.score - best) < 0.06, row
        if best:
            assert abs(score(plain[row.location], plain[row.matched_location]) - best) < 1e-9, row
            # Of equal scores the first in option order wins, which is alphabetical here.
            as_good = [k for k in known if abs(score(plain[row.location], plain[k]) - best) < 1e-9]
            assert row.matched_location == min(as_good, key=lambda k: (k.lower(), k)), (row, as_good)


def test_decided_texts_are_not_joined_on_common_words(spark, monkeypatch):
    """With a rare word that settles the match, the words that all locations have are never looked up."""
    known = [(f"place{k} station road west",) for k in range(300)] + [("lone station",)]
    asked = [(f"place{k} station road east",) for k in range(0, 300, 3)] + [("road station far west",)]
    looked_up = []
    may_improve = match._may_improve

    def watched(done):
        looked_up.append(done)
        return may_improve(done)

    monkeypatch.setattr(match, "_may_improve", watched)
    frames = [spark.createDataFrame(rows, "location string") for rows in (asked, known)]
    got = {r["location"]: r["matched_location"] for r in match.match_locations(*frames).collect()}
    assert all(got[f"place{k} station road east"] == f"place{k} station road west" for k in range(0, 300, 3))
    assert got["road station far west"] == "place0 station road west"
    questions = match._questions(
        spark.createDataFrame([("a b c d",), ("a b x d",)], "text string"),
        spark.createDataFrame([("a", 1), ("b", 50), ("d", 9)], "word string, holders long"),
    ).collect()
    assert [[w["word"] for w in q.question.known] for q in questions] == [["a", "d", "b"]] * 2
    assert questions[0].question == questions[1].question and max(looked_up) <= 4


def write(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content, encoding="utf-8")


def test_feed(spark, tmp_path):
    write(tmp_path, "routes.txt", "﻿route_id,route_short_name,route_long_name,route_type\n1,29,DUFFERIN,3\n2,501,QUEEN,0\n3,1,YONGE LINE,1\n4,5,X LINE,3\n")
    write(tmp_path, "trips.txt", "route_id,service_id,trip_id\n1,s,a\n1,s,b\n2,s,c\n")
    write(tmp_path, "stop_times.txt", "trip_id,arrival_time,departure_time,stop_id,stop_sequence\na,,,p,1\na,,,q,2\nb,,,q,1\nb,,,p,2\nc,,,p,1\nc,,,r,2\nc,,,q,x\n")
    write(tmp_path, "stops.txt", "stop_id,stop_name,stop_lat,stop_lon\np,King St,43.6,-79.4\nq,Queen St,43.7,-79.4\nr,East Stn,43.6,-79.2\n")
    tables = {n: feed.read_feed_table(spark, str(tmp_path), n) for n in feed.FEED_COLUMNS}
    index = feed.route_index(**tables)
    assert [(r["route"], r["mode"], r["label"]) for r in index.routes.collect()] == [("29", "bus", "29 - DUFFERIN"), ("501", "streetcar", "501 - QUEEN")]
    assert {r["route"]: r["directions"] for r in index.directions.collect()} == {"29": ["N", "S"], "501": ["E"]}
    asked = spark.createDataFrame([("29A", "king st"), ("29", "mars"), ("77", "king st")], "route string, location string")
    got = {r["route"]: r for r in feed.validate_route_locations(asked, index).collect()}
    assert got["29A"]["accepted_for_prediction"] and got["29A"]["warning"].startswith("Using base route 29")
    assert not got["29"]["accepted_for_prediction"] and "not a stop on route 29" in got["29"]["warning"]
    assert "was not found" in got["77"]["warning"]
    ways = {r["route"]: r for r in feed.resolve_routes(asked, index).collect()}
    assert ways["29A"]["direction_options"] == ["N", "S", "B"] and ways["77"]["route_mode"] is None


def test_drifting_files_to_cleaned_table(spark, tmp_path):
    write(tmp_path / "bus", "a.csv", "Report Date,Time,Line,Bound,Location,Incident,Delay,Gap,Vehicle\n2024-07-01,08:30,29.0,N/B,King,Mech,10,5,123.0\n2024-07-02,08:30,29,N,King,Mech,-1,5,1\n")
    write(tmp_path / "bus" / "old", "b c.csv", "Date,Route,Min Delay\n2023-01-05,7,12\nbad,7,12\n2023-01-06,7,x\n")
    write(tmp_path / "bus", "~$a.csv", "Date,Route,Min Delay\n2023-01-05,7,12\n")
    assert discover_files(spark, str(tmp_path / "bus")).count() == 2
    raw = read_incident_files(spark, str(tmp_path / "bus"), "bus")
    assert {r["source_file"] for r in raw.select("source_file").distinct().collect()} == {"a.csv", "b c.csv"}
    (tmp_path / "none").mkdir()
    cleaned = clean_all(spark, {"bus": str(tmp_path / "bus"), "streetcar": str(tmp_path / "none")})
    got = sorted((str(r["ts"]), r["route"], r["min_delay"], r["hour"], r["is_holiday"], r["vehicle"]) for r in cleaned.collect())
    assert got == [("2023-01-05 00:00:00", "7", 12.0, 0, 0, None), ("2024-07-01 08:30:00", "29", 10.0, 8, 1, "123")]
    write_cleaned(cleaned, str(tmp_path / "out"))
    assert read_cleaned(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(FileNotFoundError):
        clean_all(spark, {"bus": str(tmp_path / "none")})


def test_quotes_line_breaks_and_repeated_headers(spark, tmp_path):
    write(tmp_path / "a", "q.csv", '\ufeffDate,date,Location,Min Delay,Delay\n2024-01-01,1999-01-01,"KING ""X"", ST",3,99\n2024-01-02,,"two\nlines",4,\n')
    got = read_incident_files(spark, str(tmp_path / "a"), "bus").orderBy("date").collect()
    assert [(r.date, r.location, r.min_delay) for r in got] == [("2024-01-01", 'KING "X", ST', "3"), ("2024-01-02", "two\nlines", "4")]
    assert set(got[0].asDict()) == {"date", "location", "min_delay", "source_file", "source_mode", "source_sheet"}


def test_split_and_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", float("nan")), ("test", 1.0)], "split string, v double")
    write_splits(df, str(tmp_path / "s"))
    assert read_split(spark, str(tmp_path / "s"), "test").count() == 1
    write_report(df, str(tmp_path / "r"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert {line["split"]: line["v"] for line in lines} == {"train": None, "test": 1.0}


def _runs_of(spark, query):
    """How often the given rows are made while a query runs and is read."""
    counted = spark.sparkContext.accumulator(0)

    def one(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    schema = "split string, mode string, y int, p double, actual double, prediction double, error double, absolute_error double"
    base = spark.range(40, numPartitions=2).select(
        F.when(F.col("id") % 2 == 0, "validation").otherwise("test").alias("split"), F.lit("bus").alias("mode"),
        (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") / 40).alias("p"), F.col("id").cast("double").alias("actual"),
        F.lit(20.0).alias("prediction"), (20.0 - F.col("id")).alias("error"), F.abs(20.0 - F.col("id")).alias("absolute_error"),
    )
    assert query(base.mapInArrow(one, schema)).collect()
    return counted.value / 40


def test_rows_of_a_report_are_made_once(spark):
    """Rows that history makes costly are not made again for each metric."""
    assert _runs_of(spark, lambda df: metrics.cutoff_table(df, ["split"], "y", "p")) == 1
    assert _runs_of(spark, lambda df: metrics.reliability_bins(df, ["split"], "y", "p")) == 1
    assert _runs_of(spark, lambda df: metrics.band_summary(df, ["split"], "y", "p")) == 1
    assert _runs_of(spark, lambda df: reports.high_delay(df)) == 1
    assert _runs_of(spark, lambda df: reports.error_contribution(df, ["mode"])) == 1


def test_known_categories_are_made_once_for_all_fields(spark):
    def query(df):
        known = df.select(F.lit("route").alias("field"), F.col("actual").cast("int").cast("string").alias("value"))
        asked = spark.createDataFrame([("bus", "7", "N", "Mech", "A")], "mode string, route string, direction string, incident string, location string")
        return validate_requests(asked, known)

    assert _runs_of(spark, query) == 1
