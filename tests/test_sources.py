import hashlib
import hmac
import json
import pytest
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from findinglake.operators.lifecycle import History, ScanBatch
from findinglake.sources import advisories as adv
from findinglake.sources import patches as pt
from findinglake.sources.files import collect_from_paths
from findinglake.sources.webhooks import parse_events, signature_state
from findinglake.streaming import ingest


def sequential(patch):
    out, hunk, new, old, position = [], 0, 0, 0, 0
    for raw in patch.split("\n"):
        head = re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", raw)
        if head:
            hunk, old, new, position = hunk + 1, int(head[1]), int(head[2]), position + 1
        elif hunk and not raw.startswith("\\"):
            position += 1
            kind = {"+": "add", "-": "del"}.get(raw[:1], "context")
            out.append((hunk, kind, raw[1:], None if kind == "del" else new, None if kind == "add" else old, position))
            new += kind != "del"
            old += kind != "add"
    return out


def random_patch(rng):
    lines = ["noise"]
    for _ in range(rng.randrange(1, 4)):
        lines.append(f"@@ -{rng.randrange(1, 50)},3 +{rng.randrange(1, 50)}{rng.choice(['', ',4'])} @@ f")
        lines += [rng.choice("+- ") + f"l{rng.randrange(9)}" for _ in range(rng.randrange(0, 6))]
        lines += rng.choice([[], ["\\ No newline at end of file"], [""]])
    return "\n".join(lines)


def test_patch_numbering_matches_a_sequential_walk(spark):
    rng = random.Random(5)
    patches = [(i, random_patch(rng)) for i in range(60)]
    df = spark.createDataFrame(patches, "id long, patch string")
    in_row = df.select("id", F.explode(pt.parsed_lines(F.col("patch"))).alias("l")).select("id", "l.*").collect()
    as_rows = pt.numbered_lines(df, ["id"]).collect()
    for got in (in_row, as_rows):
        by_id = {}
        for r in got:
            by_id.setdefault(r.id, []).append((r.hunk, r.kind, r.content, r.new_line, r.old_line, r.position))
        for i, patch in patches:
            assert sorted(by_id.get(i, []), key=lambda x: x[5]) == sequential(patch)


def test_reconstruction(spark):
    patch = "@@ -1,2 +2,2 @@\n a\n-b\n+c\n@@ -9 +6 @@\n+z"
    text = spark.createDataFrame([(patch,)], "p string").select(pt.reconstructed(pt.parsed_lines(F.col("p")))).first()[0]
    assert text == "\na\nc\n\n\nz"


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("eval(x)\n")
    (tmp_path / "src" / "big.py").write_text("x" * 50)
    (tmp_path / "src" / "bin.py").write_bytes(b"a\x00b")
    (tmp_path / "src" / "hex.py").write_bytes(b"p\x10\x01")
    (tmp_path / "src" / "pic.png").write_text("x")
    (tmp_path / "node_modules" / "b.js").write_text("eval(x)")
    roots = [str(tmp_path), str(tmp_path / "src")]
    files, skipped = collect_from_paths(spark, roots, str(tmp_path), max_bytes=40)
    assert sorted(r.file_path for r in files.collect()) == ["src/a.py", "src/hex.py"]
    assert [r.file_path for r in skipped.collect()] == ["src/big.py"]


def payload(action="opened", **pull):
    return json.dumps({
        "action": action, "number": 7, "pull_request": {"head": {"sha": "abc"}, **pull},
        "repository": {"name": "r", "owner": {"login": "o"}},
    })


def test_event_routing(spark):
    rows = [
        ("1", "ping", "{}"), ("2", "push", "{}"), ("3", "pull_request", payload()), ("4", "pull_request", payload("closed")),
        ("5", "pull_request", payload(draft=True)), ("6", "pull_request", payload("ready_for_review", draft=True)),
        ("7", "pull_request", json.dumps({"action": "opened"})), ("8", None, "{}"),
    ]
    got = {r.delivery: r for r in parse_events(spark.createDataFrame(rows, ingest.DELIVERIES)).collect()}
    assert [got[str(i)].kind for i in range(1, 9)] == [
        "ping", "ignored", "pull_request", "ignored", "ignored", "pull_request", "ignored", "ignored",
    ]
    assert got["3"].pull_number == 7 and got["3"].head_sha == "abc"
    assert got["8"].reason == "unhandled event type: unknown"


def test_signatures(spark):
    body = '{"a": 1}'
    good = "sha256=" + hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    rows = [(body, good), (body + " ", good), (body, None), (body, "sha1=x"), (body, "sha256=00")]
    df = spark.createDataFrame(rows, "b string, h string").coalesce(1)
    states = [r[0] for r in df.select(signature_state(F.col("b"), F.col("h"), "k")).collect()]
    assert states == ["ok", "mismatch", "missing-signature", "malformed-signature", "mismatch"]
    assert df.select(signature_state(F.col("b"), F.col("h"), "")).first()[0] == "missing-secret"


def test_advisory_records(spark):
    detail = {
        "id": "GHSA-1", "aliases": ["X", "CVE-9"], "details": " First line \nsecond",
        "severity": [{"type": "CVSS_V3", "score": "7.5"}],
        "affected": [
            {"package": {"ecosystem": "npm", "name": "other"}, "ranges": [{"events": [{"fixed": "0.1"}]}]},
            {"package": {"ecosystem": "npm", "name": "PKG"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.0"}]}]},
        ],
    }
    df = spark.createDataFrame([(json.dumps(detail),)], "b string").select(F.from_json("b", adv.DETAIL_JSON).alias("d"))
    a = df.select(adv.to_advisory(F.col("d"), F.lit("npm"), F.lit("pkg")).alias("a")).first().a
    assert (a.cve, a.severity, a.fixed_in, a.summary) == ("CVE-9", "high", "2.0", "First line")


def test_cache_expiry_and_negative_answers(spark):
    now = datetime(2024, 1, 1)
    queries = spark.createDataFrame([("npm", "A", "1"), ("npm", "a", "1"), ("npm", "b", "1"), ("npm", "", "1")], "ecosystem string, name string, version string")
    empty = spark.createDataFrame([], "ecosystem string, name string, version string, at int, cve string, severity string, fixed_in string, summary string")
    cache = adv.cache_rows(queries, empty, F.lit(now).cast("timestamp_ntz"))
    assert cache.count() == 2
    for later, pending in ((datetime(2024, 1, 1, 5), 0), (datetime(2024, 1, 1, 7), 2)):
        _, rest = adv.split_cached(queries, cache, F.lit(later).cast("timestamp_ntz"))
        assert rest.count() == pending


def test_a_diff_in_a_file_is_read_in_parts(spark, tmp_path):
    """Sections that byte ranges cut, a path named twice, a section with text like a header, and a diff without headers."""
    rng = random.Random(3)
    parts = []
    for k in range(4000):
        name = f"src/f{k % 3900}.py"
        body = "\n".join(rng.choice(["+", "-", " "]) + "x" * rng.randrange(300) + rng.choice(["", " diff --git a b"]) for _ in range(rng.randrange(1, 40)))
        parts.append(f"diff --git a/{name} b/{name}\nindex 1..2\n--- a/{name}\n+++ b/{name}\n@@ -1,9 +1,9 @@\n{body}\n")
    parts.append("diff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n")
    whole = "".join(parts)
    (tmp_path / "all.diff").write_text(whole)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(whole) // 20))
    try:
        found = pt.read_diff(spark, f"file://{tmp_path}/all.diff")
        assert spark.read.option("lineSep", "\ndiff --git ").text(f"file://{tmp_path}/all.diff").rdd.getNumPartitions() >= 10
        got = {r.path: r.patch for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    frame = spark.createDataFrame([(1, whole)], "id int, diff string")
    assert got == {r.path: r.patch for r in pt.split_multi_file_diff(frame, ["id"]).collect()} and len(got) == 3900
    (tmp_path / "bare.diff").write_text("--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n")
    assert [tuple(r) for r in pt.read_diff(spark, f"file://{tmp_path}/bare.diff").collect()] == [("x.py", "@@ -1 +1 @@\n-a\n+b")]


def test_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(
        json.dumps({"delivery": str(i), "event": "pull_request", "payload": payload(a)}) for i, a in enumerate(["opened", "closed"])
    ))
    query = ingest.write_reviewable(ingest.read_deliveries(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def delivered(inbox, name, *rows):
    lines = [{"delivery": i, "event": "pull_request", "payload": payload("opened"), "received_at": at} for i, at in rows]
    (inbox / name).write_text("\n".join(json.dumps(line) for line in lines))


def test_a_repeated_delivery_passes_once_and_a_late_one_never(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        ingest.write_reviewable(ingest.read_deliveries(spark, str(inbox), 1), out, ck, "10 minutes").awaitTermination(180)
        return sorted(str(r.delivery) for r in spark.read.parquet(out).collect())

    delivered(inbox, "1.json", ("a", "2024-01-01T12:00:00Z"), ("a", "2024-01-01T12:00:01Z"), (None, "2024-01-01T12:00:00Z"), (None, "2024-01-01T12:00:00Z"))
    assert run() == ["None", "None", "a"]
    # The same id in a later micro-batch, and a new one.
    delivered(inbox, "2.json", ("a", "2024-01-01T12:05:00Z"), ("b", "2024-01-01T12:06:00Z"))
    assert run() == ["None", "None", "a", "b"]
    # The newest delivery moves the watermark to 12:50; what was received before that is late.
    delivered(inbox, "3.json", ("c", "2024-01-01T13:00:00Z"))
    assert run() == ["None", "None", "a", "b", "c"]
    delivered(inbox, "4.json", ("late", "2024-01-01T12:07:00Z"), ("d", "2024-01-01T12:55:00Z"))
    assert run() == ["None", "None", "a", "b", "c", "d"]


def test_kept_answers_are_served_expire_and_are_asked_for_again(spark, tmp_path):
    """Step by step against the batch form, with the times that the stream itself met."""
    import time

    from findinglake.streaming import advisory_cache as cache

    question = "ecosystem string, name string, version string"
    inbox, seen, seconds = tmp_path / "in", [], 30
    inbox.mkdir()
    before = {key: spark.conf.get(key) for key in cache.SETTINGS}
    for key, value in cache.SETTINGS.items():
        spark.conf.set(key, value)

    def step(name, rows):
        rows.coalesce(1).write.mode("append").json(str(inbox))
        stream = cache.served(spark.readStream.schema(cache.MESSAGES).json(str(inbox)), seconds / 3600)

        def keep(batch, _):
            seen.extend((name, r.key_name, r.name, r.status, r.advisories) for r in batch.collect())

        begun = datetime.now()
        query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
        return begun

    try:
        asked = spark.createDataFrame([("npm", "Left", "1"), ("npm", "left", "1"), ("npm", "pad", "2"), ("npm", "", "1")], question)
        step("first", cache.as_messages(asked))
        told = spark.createDataFrame([("npm", "left", "1", ["CVE-1"]), ("npm", "pad", "2", [])], f"{question}, a array<string>")
        at = step("told", cache.as_messages(told, F.col("a")))
        step("served", cache.as_messages(asked))
        held = spark.createDataFrame(
            [("npm", "left", "1", ["CVE-1"], at + timedelta(seconds=seconds)), ("npm", "pad", "2", [], at + timedelta(seconds=seconds))],
            f"{question}, advisories array<string>, expires_at timestamp_ntz",
        )
        now = F.lit(datetime.now()).cast("timestamp_ntz")
        answered, pending = adv.split_cached(asked, held, now)
        assert sorted(x[1:] for x in seen if x[0] == "served") == sorted(
            (r.key_name, r.name, "answered", json.dumps(r.advisories, separators=(",", ":"))) for r in answered.collect()
        ) and pending.count() == 0
        time.sleep(max(0, seconds + 2 - (datetime.now() - at).total_seconds()))
        step("expired", cache.as_messages(asked))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    pending = sorted((r.key_name, r.name, "pending", None) for r in adv.split_cached(asked, held, F.lit(datetime.now()).cast("timestamp_ntz"))[1].collect())
    assert len(pending) == 2
    assert sorted(x[1:] for x in seen if x[0] == "first") == pending == sorted(x[1:] for x in seen if x[0] == "expired")


def test_scan_stream_feeds_the_history(spark, tmp_path):
    inbox = tmp_path / "scans"
    inbox.mkdir()

    def run(day, findings):
        return {"full_name": "o/a", "scanned_at": f"2024-01-0{day}T00:00:00", "pull_request_number": day, "files_scanned": 1,
                "findings": findings, "examined": [{"path": "a.py", "lines": None}]}

    hit = {"fingerprint": "x", "rule_id": "r/x", "category": "secrets", "severity": "high", "file_path": "a.py", "line": 3, "title": "t"}
    (inbox / "1.json").write_text("\n".join(json.dumps(r) for r in (run(1, [hit]), run(2, []))))
    schema = spark.createDataFrame(
        [], "full_name string, scanned_at timestamp_ntz, pull_request_number long, files_scanned long, "
        "findings array<struct<fingerprint:string,rule_id:string,category:string,severity:string,file_path:string,line:int,title:string>>, "
        "examined array<struct<path:string,lines:array<int>>>"
    ).schema
    history = History(spark, str(tmp_path / "history"))
    ingest.record_stream(spark, str(inbox), schema, history, str(tmp_path / "ck2")).awaitTermination(180)
    assert history.version() == 1  # both scans of the repository are folded in one pass
    row = history.tables().finding_state.first()
    assert (row.status, row.first_seen_at.day, row.resolved_at.day) == ("resolved", 1, 2)


def test_replayed_stream_changes_nothing_and_each_repository_keeps_its_time(spark, tmp_path):
    inbox = tmp_path / "scans"
    inbox.mkdir()
    hit = {"fingerprint": "x", "rule_id": "r/x", "category": "secrets", "severity": "high", "file_path": "a.py", "line": 3, "title": "t"}
    rows = [
        {"full_name": name, "scanned_at": f"2024-01-0{day}T00:00:00", "pull_request_number": day, "files_scanned": 1,
         "findings": [hit], "examined": [{"path": "a.py", "lines": None}]}
        for name, day in (("o/a", 1), ("o/b", 5), ("o/b", 6))
    ]
    (inbox / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    schema = spark.createDataFrame(
        [], "full_name string, scanned_at timestamp_ntz, pull_request_number long, files_scanned long, "
        "findings array<struct<fingerprint:string,rule_id:string,category:string,severity:string,file_path:string,line:int,title:string>>, "
        "examined array<struct<path:string,lines:array<int>>>"
    ).schema
    history = History(spark, str(tmp_path / "history"))

    def contents():
        store = history.tables()
        return [sorted(map(str, t.collect())) for t in (store.repositories, store.scans, store.finding_state, store.findings)]

    ingest.record_stream(spark, str(inbox), schema, history, str(tmp_path / "ck1")).awaitTermination(180)
    before = contents()
    assert [len(t) for t in before] == [2, 3, 2, 3]
    seen = {r.full_name: (r.first_seen_at.day, r.last_seen_at.day) for r in history.tables().finding_state.join(
        history.tables().repositories.withColumnRenamed("id", "repository_id"), "repository_id").collect()}
    assert seen == {"o/a": (1, 1), "o/b": (5, 6)}
    ingest.record_stream(spark, str(inbox), schema, history, str(tmp_path / "ck2")).awaitTermination(180)
    assert contents() == before


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    history = History(spark, str(tmp_path / "history"))
    versions = iter([0, 1])
    monkeypatch.setattr(history, "version", lambda: next(versions))
    scans = spark.createDataFrame([("o/a", 1)], "full_name string, pull_request_number long")
    findings = spark.createDataFrame([], "full_name string, seq int, fingerprint string, rule_id string, category string, severity string, "
                                     "file_path string, line int, title string")
    examined = spark.createDataFrame([("o/a", "a.py", None)], "full_name string, path string, lines array<int>")
    with pytest.raises(RuntimeError):
        history.record(ScanBatch(scans, findings, examined), datetime(2024, 1, 1))


def test_verdicts_are_read_item_by_item(spark):
    from findinglake.operators.verdicts import parse_verdicts

    good = {"fingerprint": "a", "verdict": "confirmed", "reasoning": "\n it is so \t", "fix": " \r\n", "severity": "high", "confidence": "high"}
    items = ["oops", 3, None, good, {**good, "fingerprint": "b", "reasoning": 7}, {**good, "fingerprint": "c", "reasoning": " \n\t "}]
    answers = spark.createDataFrame([(1, json.dumps({"findings": items}), None, "m")], "k int, tool_json string, text string, model string")
    asked = spark.createDataFrame([(1, x, "high") for x in "abc"], "k int, fingerprint string, severity string")
    rows = parse_verdicts(answers, asked, ["k"]).collect()
    assert [(r.fingerprint, r.reasoning, r.fix) for r in rows] == [("a", "it is so", None)]


def test_a_patch_of_a_hundred_thousand_lines(spark):
    body = "\n".join(("+new", " same", "-old")[k % 3] for k in range(99_999))
    df = spark.createDataFrame([(f"@@ -1,2 +1,2 @@\n{body}",)], "patch string").select(pt.parsed_lines(F.col("patch")).alias("l"))
    row = df.select(F.size("l").alias("n"), F.element_at("l", -1).alias("last"), F.element_at("l", -2).alias("kept")).first()
    assert row.n == 99_999 and row["last"].old_line == 66_666 and row.kept.new_line == 66_666 and row.kept.old_line == 66_665


def test_files_are_read_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.py").write_text("x = 1")
    roots = [str(tmp_path / "a"), str(tmp_path / "a" / "b"), str(tmp_path / "a") + "/"]
    files, _ = collect_from_paths(spark, roots, str(tmp_path))
    assert [r.file_path for r in files.collect()] == ["a/b/x.py"]
    assert "Exchange" not in files._jdf.queryExecution().executedPlan().toString()
