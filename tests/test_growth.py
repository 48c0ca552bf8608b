"""What keeps work small as the history grows: rollups, quotas, hot keys, look-alikes by hash, statements once."""

import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from findinglake.operators import lifecycle as lc
from findinglake.operators.dependency_rules import lookalikes
from findinglake.operators.hot_keys import SALTS, hot_keys, join_hot, repeated, salted
from findinglake.operators.quota import resolve_oldest
from findinglake.operators.sql_rules import uncovered
from findinglake.plans import dashboard, rollups
from findinglake.schemas import FINDING_STATE
from findinglake.sources.tables import Store
from tests.test_lifecycle import STATE0, finding
from tests.test_lifecycle import _batch as batch_of


def test_quotas_equal_a_fold_over_the_days(spark):
    rng = random.Random(1)
    rows, quotas, want = [], [], {}
    for repo in range(12):
        rows += [
            (repo, f"f{k:03}", datetime(2024, 1, 1) + timedelta(hours=rng.choice([0, 0, 5, 23, 24, 25, 47, 48, 100, 200]), minutes=rng.choice([0, 0, 30])))
            for k in range(rng.randrange(40))
        ]
        quotas += [(repo, date(2023, 12, 30) + timedelta(days=d), rng.randrange(6)) for d in range(12) for _ in range(rng.randrange(3))]
        waiting = sorted((at, name) for r, name, at in rows if r == repo)
        for day, n in sorted(q[1:] for q in quotas if q[0] == repo):
            for found in [w for w in waiting if w[0].date() <= day][:n]:
                waiting.remove(found)
                want[repo, found[1]] = day
        want.update({(repo, name): None for _, name in waiting})
    rows.append((3, "untimed", None))
    want[3, "untimed"] = None
    rows.append((99, "no quota", datetime(2024, 1, 1)))
    want[99, "no quota"] = None
    found = resolve_oldest(
        spark.createDataFrame(rows, "repository_id long, fingerprint string, first_seen_at timestamp_ntz"),
        spark.createDataFrame([*quotas, (3, None, 5), (55, date(2024, 1, 1), 9)], "repository_id long, day date, n long"),
    )
    assert {(r.repository_id, r.fingerprint): r.resolved_on for r in found.collect()} == want and found.count() == len(rows)


def test_days_that_batches_keep_up_give_the_trends_of_the_state(spark, tmp_path):
    history = lc.History(spark, str(tmp_path / "h"))
    rng = random.Random(4)
    for day in range(5):
        found = [finding(f"f{rng.randrange(9)}", rng.randrange(1, 5), severity=rng.choice(["high", "low"]), seq=s) for s in range(rng.randrange(5))]
        history.record(batch_of(spark, rng.choice(["o/a", "o/b"]), found, [("a.py", rng.choice([None, [1, 2]]))]), STATE0 + timedelta(days=day, hours=day))
    store = history.tables()
    store = Store(store.repositories, store.scans, store.finding_state, store.findings, ("secrets",))
    days = history.days()
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, rollups.day_changes(None, store.finding_state).collect()))
    for repository in (None, "o/a"):
        for length in (3, 30):
            flt = dashboard.StatsFilter(as_of=STATE0 + timedelta(days=6), days=length, repository=repository)
            for made, plain in (
                (rollups.trend(days, store, flt, True), dashboard.trend(store, flt, True)),
                (rollups.category_trend(days, store, flt), dashboard.category_trend(store, flt)),
            ):
                assert made.columns == plain.columns and sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))


def test_a_trend_reads_days_and_repositories_only(spark, tmp_path):
    days = spark.createDataFrame([(1, date(2024, 1, 1), "high", "secrets", 2, 1)], rollups.DAYS)
    days.write.parquet(str(tmp_path / "days"))
    repos = spark.createDataFrame([(1, "o/a")], "id long, full_name string")
    repos.write.parquet(str(tmp_path / "repos"))
    nothing = spark.createDataFrame([], FINDING_STATE)
    store = Store(spark.read.parquet(str(tmp_path / "repos")), nothing, nothing, nothing)
    made = rollups.trend(spark.read.parquet(str(tmp_path / "days")), store, dashboard.StatsFilter(as_of=datetime(2024, 1, 2), days=30))
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2
    assert {tuple(r)[1:] for r in made.collect()} == {(0, 0, 0), (2, 1, 1), (0, 0, 1)}


def test_hot_keys_are_found_and_their_rows_spread(spark):
    rows = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 7000).cast("string"))).alias("key")
    )
    assert hot_keys(rows, "key") == ["hot"] and hot_keys(rows.where("id < 0"), "key") == []
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "key string, x int")
    spread = salted(rows, "key", ["hot"], [F.col("id")])
    sizes = [r["count"] for r in spread.where("key = 'hot'").groupBy("salt").count().collect()]
    assert len(sizes) == SALTS and max(sizes) < 2 * 10_000 / SALTS
    partitions = spread.repartition(16, "key", "salt").groupBy(F.spark_partition_id()).count().collect()
    plain = rows.repartition(16, "key").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in partitions) < 30_000 / 6 < max(r["count"] for r in plain)
    assert repeated(right, "key", ["hot"]).count() == 2 * SALTS + 2
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(right, "key", how).select("key", "id", "x").collect()))
        assert sorted(map(str, join_hot(rows, right, "key", [F.col("id")], how).select("key", "id", "x").collect())) == want


def _near(a, b):
    """One edit apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:k] + long_[k + 1 :] == short for k in range(len(long_)))


def test_lookalikes_of_a_long_list(spark):
    rng = random.Random(2)
    popular = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 14))) for _ in range(60_000)})
    rng.shuffle(popular)
    popular = popular[:50_000]
    place = {p: k for k, p in enumerate(popular)}
    names = [rng.choice(popular) for _ in range(60)] + ["", "x" * 100_000, "é", "ab\nc"]
    for _ in range(60):
        name = rng.choice(popular)
        at = rng.randrange(len(name) + 1)
        names.append(name[:at] + rng.choice(["", "q", "a"]) + name[at + rng.randrange(2) :])
    want = {}
    for name in names:
        near = min((place[p] for p in popular if abs(len(p) - len(name)) < 2 and _near(p, name)), default=None)
        want[name] = popular[near] if near is not None and near < place.get(name, 1 << 30) else None
    listed = spark.createDataFrame(list(place.items()), "name string, place int")
    found = lookalikes(spark.createDataFrame([(n,) for n in names], "name string"), listed).collect()
    assert len(found) == len(names) and {r.name: r.near for r in found} == want


def _kept(spark, hits):
    frame = spark.createDataFrame([(hits,)], "hits array<struct<line:int,end_line:int>>")
    return [h.line for h in frame.select(uncovered(F.col("hits")).alias("k")).first().k]


def test_statements_are_judged_once_in_time_in_proportion(spark):
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 17, 200):
        line, hits, want, upto = 0, [], [], 0
        for _ in range(n):
            line += rng.choice([1, 1, 1, 2, 9])
            hits.append((line, line + rng.randrange(0, 6)))
        for start, end in hits:
            if start > upto:
                want.append(start)
                upto = end
        assert _kept(spark, hits) == want

    def seconds(n):
        hits = [(k, k + 2) for k in range(1, n + 1)]
        began = time.perf_counter()
        assert _kept(spark, hits) == list(range(1, n + 1, 3))
        return time.perf_counter() - began

    seconds(1000)
    few, many = seconds(5_000), seconds(50_000)
    assert many < 30 * max(few, 0.2)


@pytest.mark.parametrize("keys", [(), ("repo",)])
def test_live_advisories_meet_hot_packages(spark, keys):
    from findinglake.operators.scan import ScanOptions, scan

    manifest = '{\n  "dependencies": {\n    "%s": "1.0.0"\n  }\n}'
    files = [(k, f"s{k}/package.json", manifest % ("hotpkg" if k % 3 == 0 else f"p{k}x"), "modified", None, "r") for k in range(300)]
    frame = spark.createDataFrame(files, "file_idx long, file_path string, content string, status string, changed_lines array<int>, repo string")
    live = spark.createDataFrame(
        [("npm", "HotPkg", "2", "CVE-1", "high", "s"), ("npm", "hotpkg", "2", "CVE-2", "low", "s"), ("npm", "p1x", "2", "CVE-3", "low", "s")],
        "ecosystem string, name string, fixed_in string, cve string, severity string, summary string",
    )
    found = scan(frame, ScanOptions(categories=("dependencies",), keys=keys), live).where("rule_id like '%known-vulnerable%'").collect()
    assert len(found) == 201 and len({r.fingerprint for r in found}) == 201


FILES_OF_REPOS = "file_idx long, file_path string, content string, status string, changed_lines array<int>, repo string"
LIVE = "ecosystem string, name string, fixed_in string, cve string, severity string, summary string"


def _manifest(used, built):
    def lines(pairs):
        return ",\n".join(f'    "{name}": "{version}"' for name, version in pairs)

    return '{\n  "dependencies": {\n%s\n  },\n  "devDependencies": {\n%s\n  }\n}' % (lines(used), lines(built))


def _above(plan, mark):
    """The operators above the one whose line has the mark."""
    lines = [line for line in plan.split("\n") if line.strip()]
    depths = [next(k for k, c in enumerate(line) if c.isalpha()) for line in lines]
    at = next(k for k, line in enumerate(lines) if mark in line)
    found, depth = [], depths[at]
    for k in range(at - 1, -1, -1):
        if depths[k] < depth:
            found.append(lines[k])
            depth = depths[k]
    return found


def test_findings_of_live_advisories_are_not_shuffled(spark):
    from findinglake.operators.scan import ScanOptions, scan

    files = [(k, f"s{k}/package.json", _manifest([("pkg", "1.0.0")], []), "modified", None, "r") for k in range(40)]
    live = spark.createDataFrame([("npm", "pkg", "2", f"CVE-{k}", "high", "s") for k in range(50)], LIVE)
    found = scan(spark.createDataFrame(files, FILES_OF_REPOS), ScanOptions(categories=("dependencies",)), live)
    above = _above(found._jdf.queryExecution().optimizedPlan().toString(), "(salt#")
    assert above and not any(word in line for line in above for word in ("Aggregate", "Repartition", "Window", "Sort"))
    assert found.count() == 40 * 50 == found.select("fingerprint").distinct().count()


@pytest.mark.parametrize(
    "keys, floor, odd", [((), "low", ()), (("repo",), "info", ()), (("repo",), "high", ("CVE 9",)), ((), "info", ("",))],
    ids=["plain", "keys", "space", "empty"],
)
def test_live_findings_equal_those_told_apart_after_the_join(spark, keys, floor, odd):
    from findinglake.operators import scan as sc

    rng = random.Random(7)
    long_ = "n" * 210
    names = ["hotpkg", "HotPkg", "lodash", "p1", "p2", "p3", long_ + "a", long_ + "b", "unknown"]

    def declared():
        return [(rng.choice(names), rng.choice(["1.0.0", "4.17.1"])) for _ in range(rng.randrange(4))]

    files = [
        (k, f"s{rng.randrange(8)}/package.json", _manifest([("hotpkg", "1.0.0")] * (k % 3 == 0) + declared(), declared()), "modified",
         rng.choice([None, None, [3, 4, 8]]), rng.choice(["a", "b", None]))
        for k in range(40)
    ]
    severities = ["critical", "high", "medium", "low", "info", None]
    rows = [("npm", rng.choice(names[:-1]), "9", f"CVE-{rng.randrange(9)}", severities[k % 6], "s") for k in range(60)]
    rows += [("npm", "lodash", "9", "CVE-2021-23337", "low", "s"), ("npm", None, "9", "CVE-1", "low", "s"), ("npm", "p1", "9", None, "low", "s")]
    rows += [("npm", name, "9", cve, "high", "s") for cve in odd for name in ("p1", "hotpkg")]
    worst = {}
    for row in sorted(rows, key=lambda r: severities.index(r[4])):
        worst.setdefault((row[1] and row[1].lower(), row[3]), row)
    frame = spark.createDataFrame(files, FILES_OF_REPOS)
    options = sc.ScanOptions(categories=("dependencies",), min_severity=floor, keys=keys)
    # Of equal advisories with several severities any may be kept, so here each comes once; below the worst decides.
    one = spark.createDataFrame(list(worst.values()), LIVE)
    columns = [*keys, "file_idx", "file_path", "rule_id", "severity", "confidence", "line", "end_line", "snippet", "title", "fingerprint"]
    after = sc.worded(sc.first_per_fingerprint(sc.to_findings(sc.meet_advisories(sc.raw_hits(frame, options), one, keys), options), keys))
    want = sorted(map(str, after.select(columns).collect()))
    assert len(want) > 30
    every = one if odd else spark.createDataFrame(rows, LIVE)
    assert sorted(map(str, sc.scan(frame, options, every).select(columns).collect())) == want
    if floor == "low":
        capped = sc.ScanOptions(categories=("dependencies",), min_severity=floor, keys=keys, max_findings_per_file=2)
        sizes = {}
        for r in after.collect():
            sizes[r.file_idx] = sizes.get(r.file_idx, 0) + 1
        assert sc.scan(frame, capped, one).count() == sum(min(n, 2) for n in sizes.values())
