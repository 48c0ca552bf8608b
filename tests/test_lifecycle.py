import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from findinglake.operators import lifecycle as lc
from findinglake.schemas import FINDING_STATE, conform

STATE0 = datetime(2024, 1, 1)
BATCH = (
    "repository_id long, fingerprint string, rule_id string, category string, severity string, file_path string, "
    "line int, title string, verdict string, seq int"
)
EXAMINED = "repository_id long, path string, lines array<int>"


def finding(fp, line=1, path="a.py", severity="high", verdict=None, seq=0, repo=1):
    return (repo, fp, "r/x", "secrets", severity, path, line, f"t{severity}", verdict, seq)


def fold(state, batch, examined, now):
    """The same rules, one record at a time."""
    was_open = {k for k, r in state.items() if r["status"] == "open"}
    scope = {}
    for repo, path, lines in examined:
        key = (repo, path)
        if lines is None or scope.get(key, ()) is None:
            scope[key] = None
        else:
            scope.setdefault(key, set()).update(lines)
    for f in batch:
        if scope.get((f[0], f[5]), ()) is not None:
            scope.setdefault((f[0], f[5]), set()).add(f[6])
    seen = {(f[0], f[1]) for f in batch}
    closed = set()
    for key in was_open - seen:
        row = state[key]
        place = (key[0], row["file_path"])
        if place in scope and (scope[place] is None or row["line"] in scope[place]):
            closed.add(key)
    for f in batch:
        row = state.setdefault((f[0], f[1]), {"rule_id": f[2], "category": f[3], "verdict": None, "first": now})
        row.update(severity=f[4], file_path=f[5], line=f[6], title=f[7], status="open", last=now, resolved=None)
        row["verdict"] = f[8] or row["verdict"]
    for key in closed:
        state[key].update(status="resolved", resolved=now)
    new = sum((f[0], f[1]) not in was_open for f in batch)
    return new, len(closed)


def rows(df):
    return {
        (r.repository_id, r.fingerprint): dict(
            rule_id=r.rule_id, category=r.category, verdict=r.verdict, first=r.first_seen_at, severity=r.severity,
            file_path=r.file_path, line=r.line, title=r.title, status=r.status, last=r.last_seen_at, resolved=r.resolved_at,
        )
        for r in df.collect()
    }


def test_replay_equals_sequential_fold(spark):
    rng = random.Random(7)
    state = spark.createDataFrame([], FINDING_STATE)
    expected = {}
    for step in range(5):
        now = STATE0 + timedelta(days=step)
        batch = []
        for seq in range(rng.randrange(4, 12)):
            batch.append(
                finding(
                    f"f{rng.randrange(10)}", rng.randrange(1, 5), rng.choice(["a.py", "b.py"]), rng.choice(["high", "low"]),
                    rng.choice([None, "confirmed", "refuted"]), seq, rng.choice([1, 2]),
                )
            )
        examined = [
            (rng.choice([1, 2]), rng.choice(["a.py", "b.py"]), rng.choice([None, [1, 2], [3], []])) for _ in range(3)
        ]
        b, e = spark.createDataFrame(batch, BATCH), spark.createDataFrame(examined, EXAMINED)
        counts = lc.scan_counts(state, b, e).agg(F.sum("new_findings_count"), F.sum("resolved_findings_count")).first()
        after = lc.apply_scan(state, b, e, F.lit(now))
        collected = [tuple(r) for r in conform(after, FINDING_STATE).collect()]
        new, closed = fold(expected, batch, examined, now)
        assert tuple(counts) == (new, closed)
        state = spark.createDataFrame(collected, FINDING_STATE)
        assert rows(state) == expected


def test_untouched_line_stays_open(spark):
    state = lc.apply_scan(
        spark.createDataFrame([], FINDING_STATE), spark.createDataFrame([finding("a", 40)], BATCH),
        spark.createDataFrame([], EXAMINED), F.lit(STATE0),
    )
    nothing = spark.createDataFrame([], BATCH)
    near = spark.createDataFrame([(1, "a.py", [39, 41, 42])], EXAMINED)
    assert lc.resolved_findings(state, nothing, near).count() == 0
    whole = spark.createDataFrame([(1, "a.py", None), (1, "a.py", [2])], EXAMINED)
    assert lc.resolved_findings(state, nothing, whole).count() == 1


def _batch(spark, full_name, findings, examined):
    scans = spark.createDataFrame(
        [(full_name, 1, "h", "b", "t", "me", 1, 5)],
        "full_name string, pull_request_number long, head_sha string, base_sha string, title string, author string, "
        "files_scanned long, duration_ms long",
    )
    names = "full_name string, fingerprint string, rule_id string, category string, severity string, file_path string, line int, title string, verdict string, seq int"
    rows_ = [(full_name, *f[1:]) for f in findings]
    return lc.ScanBatch(
        scans, spark.createDataFrame(rows_, names),
        spark.createDataFrame([(full_name, *e) for e in examined], "full_name string, path string, lines array<int>"),
    )


def test_history_versions_and_retry(spark, tmp_path):
    history = lc.History(spark, str(tmp_path / "h"))
    assert history.version() == 0
    history.record(_batch(spark, "o/a", [finding("x"), finding("y", 2)], []), STATE0)
    history.record(_batch(spark, "o/b", [finding("x")], []), STATE0 + timedelta(days=1))
    history.record(_batch(spark, "o/a", [finding("x", 9)], [("a.py", None)]), STATE0 + timedelta(days=2))
    store = history.tables()
    assert sorted(r.id for r in store.repositories.collect()) == [1, 2]
    assert [r.id for r in store.scans.orderBy("id").collect()] == [1, 2, 3]
    last = store.scans.orderBy(F.desc("id")).first()
    assert (last.findings_count, last.new_findings_count, last.resolved_findings_count) == (1, 0, 1)
    states = {(r.repository_id, r.fingerprint): (r.status, r.line) for r in store.finding_state.collect()}
    assert states == {(1, "x"): ("open", 9), (1, "y"): ("resolved", 2), (2, "x"): ("open", 1)}
    assert store.findings.count() == 4
    # Folders written for a version that was never committed are not read.
    spark.createDataFrame([(9,)], "x int").write.parquet(str(tmp_path / "h" / "finding_state" / "version=4"))
    assert history.tables().finding_state.count() == 3


def sequential_scans(rng, n_repos=2, n_scans=6):
    """Scans of several repositories: (repo, scan, batch, examined), in order."""
    for scan in range(n_scans):
        for repo in range(1, n_repos + 1):
            batch = [
                finding(f"f{rng.randrange(8)}", rng.randrange(1, 5), rng.choice(["a.py", "b.py"]), rng.choice(["high", "low"]),
                        rng.choice([None, None, "confirmed", "refuted"]), seq, repo)
                for seq in range(rng.randrange(0, 5))
            ]
            yield repo, scan, batch, [(repo, rng.choice(["a.py", "b.py"]), rng.choice([None, [1, 2], [3], []])) for _ in range(rng.randrange(3))]


def test_folding_many_scans_equals_one_after_the_other(spark):
    rng = random.Random(12)
    for _ in range(3):
        expected, first = {}, []
        for _, _, batch, examined in sequential_scans(rng, n_scans=2):
            fold(expected, batch, examined, STATE0)
        first = [
            (k[0], k[1], r["rule_id"], r["category"], r["severity"], r["file_path"], r["line"], r["title"], r["status"], r["verdict"],
             r["first"], r["last"], r["resolved"])
            for k, r in expected.items()
        ]
        counts, findings, looked, times = {}, [], [], []
        for repo, scan, batch, examined in sequential_scans(rng):
            now = STATE0 + timedelta(days=scan + 1, hours=repo)
            counts[repo, scan] = (len(batch), *fold(expected, batch, examined, now))
            findings += [(*f, scan) for f in batch]
            looked += [(*e, scan) for e in examined]
            times.append((repo, scan, now))
        state = spark.createDataFrame(first, FINDING_STATE)
        when = spark.createDataFrame(times, "repository_id long, scan long, scanned_at timestamp_ntz")
        spans = lc.finding_spans(
            state, lc.fold_sightings(spark.createDataFrame(findings, f"{BATCH}, scan long"), when),
            spark.createDataFrame(looked, f"{EXAMINED}, scan long"), when,
        )
        assert rows(lc.fold_state(state, spans)) == expected
        got = {(r.repository_id, r.scan): tuple(r)[2:] for r in lc.fold_counts(spans).collect()}
        assert got == {k: c for k, c in counts.items() if any(c)}


def test_a_writer_that_comes_second_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "h")
    first, second = lc.History(spark, root), lc.History(spark, root)
    late = _batch(spark, "o/b", [finding("f2")], [])
    first.record(_batch(spark, "o/a", [finding("f1")], []), STATE0)
    before = {n: sorted(map(str, getattr(first.tables(), n).collect())) for n in ("repositories", "scans", "finding_state", "findings")}
    # The second writer read version 0 before the first committed, and never looks again: the commit itself refuses it.
    second.version = lambda: 0
    second._commits = lambda: []
    with pytest.raises(lc.TakenError):
        second.record(late, STATE0)
    assert {n: sorted(map(str, getattr(first.tables(), n).collect())) for n in before} == before
    assert [r.full_name for r in first.tables().repositories.collect()] == ["o/a"] and first.version() == 1
    assert lc.History(spark, root).record(late, STATE0) == 2
    assert sorted(r.full_name for r in first.tables().repositories.collect()) == ["o/a", "o/b"]


def test_buckets_without_the_batch_keep_their_files(spark, tmp_path):
    history = lc.History(spark, str(tmp_path / "h"))
    for name in ("o/a", "o/b", "o/c"):
        history.record(_batch(spark, name, [finding("x"), finding("y", 2)], []), STATE0)
    before = set(history.tables().finding_state.inputFiles())
    history.record(_batch(spark, "o/b", [finding("y", 7)], [("a.py", None)]), STATE0 + timedelta(days=1))
    after = set(history.tables().finding_state.inputFiles())
    touched = [f for f in before - after]
    assert len(before & after) >= len(before) - 1 and len(touched) == 1
    assert history.tables(3).finding_state.where("status = 'open'").count() == 6
    assert history.tables().finding_state.where("status = 'open'").count() == 5


def test_only_one_of_many_creates_a_file(spark, tmp_path):
    path = str(tmp_path / "c" / "1.json")
    assert [lc.create_exclusively(spark, path, text) for text in ("a", "b")] == [True, False]
    assert open(path).read() == "a" and len(list((tmp_path / "c").iterdir())) == 1


def test_dense_ids_are_consecutive(spark):
    names = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("full_name"))
    ids = [r.id for r in lc.dense_ids(names, "full_name", F.lit(10)).collect()]
    assert sorted(ids) == list(range(11, 1011))


def test_older_tables_get_the_new_columns(spark):
    old = spark.createDataFrame([(1, "f", "open")], "repository_id int, fingerprint string, status string")
    row = conform(conform(old, FINDING_STATE), FINDING_STATE).first()
    assert row.line == 0 and row.verdict is None and row.status == "open"
