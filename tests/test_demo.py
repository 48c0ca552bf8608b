from datetime import date, datetime

from findinglake.sources.demo import demo_sightings


def test_demo_history_is_repeatable(spark):
    def rows(seed):
        return sorted(map(tuple, demo_sightings(spark, datetime(2024, 5, 1), days=10, per_day=5, seed=seed).collect()))

    first = rows(1)
    assert first == rows(1) and first != rows(2) and len(first) == 50
    df = demo_sightings(spark, datetime(2024, 5, 1), days=10, per_day=5)
    assert [(r.seen_on) for r in df.select("seen_on").distinct().orderBy("seen_on").collect()][0::9] == [date(2024, 4, 22), date(2024, 5, 1)]
    assert df.select("full_name").distinct().count() <= 3
