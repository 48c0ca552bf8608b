import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from findinglake.operators.median import exact_median
from findinglake.plans import dashboard as d
from findinglake.sources.tables import Store

NOW = datetime(2024, 3, 10, 12)
STATE = (
    "repository_id long, fingerprint string, rule_id string, category string, severity string, file_path string, "
    "line int, title string, status string, verdict string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, "
    "resolved_at timestamp_ntz"
)


def store_of(spark, rows):
    repos = spark.createDataFrame([(1, "o/a"), (2, "o/b"), (3, "o/c")], "id long, full_name string")
    scans = spark.createDataFrame(
        [(1, 1, NOW - timedelta(days=2)), (2, 1, NOW - timedelta(days=40))], "id long, repository_id long, created_at timestamp_ntz"
    )
    state = spark.createDataFrame(
        [
            (repo, f"f{i}", rule, cat, sev, "p", 1, "t", "resolved" if gone else "open", verdict, first, first, gone)
            for i, (repo, rule, cat, sev, verdict, first, gone) in enumerate(rows)
        ],
        STATE,
    )
    return Store(repos, scans, state)


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(3)
    rows = []
    for _ in range(120):
        first = NOW - timedelta(days=rng.uniform(0, 20))
        # Resolutions may precede sightings, which makes the clamp bind.
        gone = rng.choice([None, first + timedelta(days=rng.uniform(-8, 6))])
        rows.append((rng.choice([1, 2]), "r/x", "secrets", rng.choice(["high", "low", "odd"]), None, first, gone))
    return rows


def test_trend_matches_sequential_balance(spark, random_rows):
    flt = d.StatsFilter(as_of=NOW, days=14)
    got = d.trend(store_of(spark, random_rows), flt, by_severity=True).orderBy("date").collect()
    start = datetime.combine(flt.first_day, datetime.min.time())
    balance = sum(r[5] < start and (r[6] is None or r[6] >= start) for r in random_rows)
    assert len(got) == 14
    for i, row in enumerate(got):
        day = flt.first_day + timedelta(days=i)
        introduced = sum(r[5].date() == day and r[5] >= start and r[3] != "odd" for r in random_rows)
        resolved = sum(r[6] is not None and r[6].date() == day and r[6] >= start for r in random_rows)
        balance = max(0, balance + introduced - resolved)
        assert (row.date, row.introduced, row.resolved, row.open) == (day, introduced, resolved, balance)
        assert row.high + row.low == introduced


def test_overview(spark):
    t = NOW - timedelta(days=5)
    rows = [
        (1, "a", "secrets", "critical", None, t, None),
        (1, "a", "secrets", "odd", None, NOW - timedelta(days=50), None),
        (2, "b", "dependencies", "low", None, t, t + timedelta(hours=3)),
    ]
    row = d.overview(store_of(spark, rows), d.StatsFilter(as_of=NOW)).first()
    assert (row.total_open, row.total_resolved, row.open_severity_critical, row.open_category_secrets) == (2, 1, 1, 2)
    assert (row.introduced_in_window, row.resolved_in_window, row.scans_in_window) == (2, 1, 1)
    assert row.repositories_tracked == 2 and row.mean_time_to_resolve_hours == 3.0
    assert row.median_open_age_days == 27.5
    empty = d.overview(store_of(spark, rows), d.StatsFilter(as_of=NOW, repository="o/c")).first()
    assert empty.total_open == 0 and empty.median_open_age_days is None and empty.mean_time_to_resolve_hours is None


def test_median_is_exact(spark):
    rng = random.Random(1)
    for size in (1, 2, 7, 30):
        ages = sorted(rng.randrange(1, 400_000) for _ in range(size))
        df = spark.createDataFrame([(NOW - timedelta(seconds=a),) for a in ages], "t timestamp_ntz")
        wanted = (ages[(size - 1) // 2] + ages[size // 2]) / 2 / 86400
        assert abs(exact_median(df, "t", NOW, F.lit(1)).first()[0] - wanted) <= 0.051


def test_noisiest_needs_enough_judgements(spark):
    t = NOW - timedelta(days=1)
    rows = [(1, "loud", "secrets", "high", v, t, None) for v in ("refuted", "refuted", "confirmed")]
    rows += [(1, "once", "secrets", "high", "refuted", t, None), (1, "fine", "secrets", "high", None, t, None)]
    store, flt = store_of(spark, rows), d.StatsFilter(as_of=NOW)
    assert [(r.rule_id, r.judged, r.refuted) for r in d.noisiest_rules(store, flt).collect()] == [("loud", 3, 2)]
    rate = d.triage_accuracy(store, flt).first()
    assert (rate.judged, rate.refuted, rate.refutation_rate) == (4, 3, 0.75)
    assert d.triage_accuracy(store, d.StatsFilter(as_of=NOW, repository="o/b")).first().refutation_rate is None


def test_summaries_keep_empty_repositories(spark):
    t = NOW - timedelta(days=1)
    got = d.repository_summaries(store_of(spark, [(2, "a", "secrets", "critical", None, t, None)])).collect()
    assert [(r.full_name, r.open, r.critical, r.scans) for r in got] == [("o/b", 1, 1, 0), ("o/a", 0, 0, 2), ("o/c", 0, 0, 0)]


def test_arguments():
    assert d.window_days("90") == 90 and d.window_days("91") == 30 and d.window_days(None) == 30
    assert d.clamp_limit("9999", 100, 500) == 500 and d.clamp_limit("x", 100, 500) == 100 and d.clamp_limit(0, 50, 200) == 50


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [(1, "a", "secrets", "high", None, NOW, None)]
    store = store_of(spark, rows)
    path = str(tmp_path / "s")
    store.finding_state.write.parquet(path)
    on_disk = Store(store.repositories, store.scans, spark.read.parquet(path))
    plan = d.open_by_group(on_disk, d.StatsFilter(as_of=NOW))._jdf.queryExecution().toString()
    assert "EqualTo(status,open)" in plan
    assert "ReadSchema: struct<repository_id:bigint,category:string,severity:string,status:string>" in plan
    assert F is not None
