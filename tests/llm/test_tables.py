"""URL filters, embedding whitening and conversation repair; ids of any type."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import numpy as np
import pytest

from findinglake.llm import bpe, conversations, html, language, quality, queries, secrets, simhash, urls, whitening
from pyspark.sql import functions as F

RULES = [
    ("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"), ("org", "", "block"), ("a.b.c.org", "/x", "allow"), ("a.b.c.org", "/x", "block"), (None, "/", "block"),
    ("", "/", "block"), ("x.com", None, "block"), ("y.com", "/", "maybe"), ("net", "/es/", "block"),
]


def brute_verdict(url, rules):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [
        (len(h) + len(p), len(h), v == "block", h.lower() + p)
        for h, p, v in rules
        if h and p is not None and v in ("allow", "block") and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], "allow" if best is None or not best[2] else "block"


def some_urls():
    chance = random.Random(4)
    found = [
        None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en",
        "http://notexample.com/en/", "http://example.com/en/", "http://m.example.com/en/a", "http://net/es/", "http://x.net/fr/?q", "a://b://c",
        "http://a.b.c.org/x", "http://z.a.b.c.org/xyz", "http://b.c.org/x", "http://org", "http://x.org#f", "http://x.com:80/", "//com/",
        "http://" + "a." * 50_000 + "com/", "http://com/" + "p" * 100_000, "http://..com//", "http://x\ny.com/en/", "http://É.com/É",
    ]
    for _ in range(300):
        host = ".".join(chance.choice(["a", "b", "c", "www", "example", "com", "net", "org", "COM"]) for _ in range(chance.randrange(1, 5)))
        found.append(f"{chance.choice(['http', ''])}://{host}{chance.choice(['', '/', '/en/', '/es/x', '/x', '?/en/'])}")
    return found


@pytest.mark.parametrize("mapped_bytes, segment_bytes", [(1 << 30, 1 << 30), (1, 60)])
def test_url_verdicts_equal_brute_force(spark, mapped_bytes, segment_bytes):
    """Also with a segment for every few entries and a pass for every segment."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(k, u, "clash", 1) for k, u in enumerate(some_urls())] + [(None, "http://com/", "c", 2), (3, "http://", "c", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, row_id int").repartition(3)
    index = urls.build_index(rules, segment_bytes)
    assert (len(index.segments) > 1) == (segment_bytes == 60) and index.labels == 4
    got = urls.judge(pages, index, mapped_bytes=mapped_bytes).collect()
    want = [(k, *brute_verdict(u, RULES)) for k, u, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_url_filters_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(pages, urls.build_index(none)).collect()] == [(1, "a.com", "/x", None, "allow")]
    rules = urls.build_index(spark.createDataFrame(RULES, none.schema))
    assert urls.judge(pages.where("false"), rules).count() == 0


def test_url_keys_are_sparks_and_collisions_are_told_apart(spark, monkeypatch):
    texts = ["", "hcom", "r" + "é" * 50, "h" + "x" * 1000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("k"), "t")
    assert all(r.k == urls.key_of(r.t) for r in frame.collect())
    index = urls.build_index(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    mapped = urls.Mapped(index.segments[0].file.removeprefix("file://"))
    keys = np.array(mapped.keys)
    monkeypatch.setattr(urls, "key_of", lambda entry: 7)
    mapped.keys = np.full(len(keys), 7)
    entries = [mapped._entry(k).decode() for k in range(len(keys))]
    assert mapped.find(entries) == list(range(len(keys))) and mapped.find(["hnothing"]) == [-1]


VECTORS = "vec_id string, embedding array<float>, component int, n string, at int"


def brute_white(rows):
    used = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in used), default=0)
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in used], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - sums / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum(int(d) ** 2 for d in n * row - sums) for row in x]
    return used, values[::-1], (centred @ vectors[:, ::-1]), deviation


def test_whitening_equals_a_plain_eigen_decomposition(spark):
    chance = np.random.default_rng(5)
    rows = [(f"v{k}", [float(c) for c in chance.normal(0.1, np.linspace(0.05, 0.4, 12))]) for k in range(300)]
    rows += [("v1", rows[1][1]), (None, rows[2][1]), ("short", [0.5, -0.5]), ("none", None), ("nan", [float("nan")] * 12),
             ("inf", [float("inf")] * 12), ("hole", [None] + [0.1] * 11), ("empty", [])]
    frame = spark.createDataFrame([(i, v, 1, "n", 2) for i, v in rows], VECTORS).repartition(3)
    got = whitening.whiten(frame).collect()
    used, values, scores, deviation = brute_white(rows)
    assert len(got) == 8 * len(used) and {r.n for r in got} == {len(used)}
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 for r in got)
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    want = sorted((str(i), d, c + 1, round(abs(s[c]) / values[c] ** 0.5, 8)) for (i, _), s, d in zip(used, scores, deviation) for c in range(8))
    mine = sorted((str(r.vec_id), r.deviation, r.component, round(abs(r.whitened), 8)) for r in got)
    assert [m[:3] for m in mine] == [w[:3] for w in want]
    assert np.allclose([m[3] for m in mine], [w[3] for w in want], atol=1e-7)


def test_whitening_of_few_or_equal_rows(spark):
    frame = spark.createDataFrame([("a", [0.1, 0.2], 1, "n", 1)] * 4 + [("b", None, 1, "n", 1)], VECTORS)
    assert whitening.whiten(frame).count() == 0 == whitening.whiten(frame.where("false")).count()
    assert whitening.whiten(frame).columns == whitening.whiten(frame.where("false")).columns
    two = spark.createDataFrame([("a", [0.0, 0.0], 1, "n", 1), ("b", [1.0, 1.0], 1, "n", 1), ("c", [1.0, 1.0], 1, "n", 1)], VECTORS)
    assert sorted((r.vec_id, r.component, round(r.explained, 12)) for r in whitening.whiten(two).collect()) == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]


def test_whitening_sums_stay_exact_for_large_numbers(spark):
    values = [[2.0**33, 1.0], [-(2.0**33), 0.25], [3.5, 0.5], [2.0**33, 1.0]]
    frame = spark.createDataFrame([(str(k), v, 1, "n", 1) for k, v in enumerate(values)], VECTORS.replace("float", "double"))
    model = whitening.fit(frame)
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in values], object)
    assert list(model.sums) == x.sum(axis=0).tolist()
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame).collect()}
    exact = [sum(int(d) ** 2 for d in 4 * row - x.sum(axis=0)) for row in x]
    assert got == {str(k): d if d < 1 << 63 else None for k, d in enumerate(exact)}
    with pytest.raises(Exception, match="2\\^44"):
        whitening.fit(spark.createDataFrame([("a", [2.0**35], 1, "n", 1)], VECTORS.replace("float", "double")))


def test_inertia_and_slicing_of_clustered_spectra():
    chance = np.random.default_rng(2)
    for d in (1, 2, 3, 9, 30):
        for _ in range(30):
            a = chance.integers(-2, 3, (d, d)).astype(float) * chance.choice([0, 1], (d, d))
            a = a + a.T
            values = np.linalg.eigvalsh(a)
            if d < 2 or np.abs(values).min() > 1e-9:
                assert whitening.positive_count(a) == (values > 1e-9).sum()
    q, _ = np.linalg.qr(chance.standard_normal((24, 24)))
    for spectrum in ([5, 5, 5, 3, 3, 1], [1e6, 1e6 * (1 - 1e-9), 1e3, 1, 1e-3], [7.0] * 24, [2, 2 - 1e-13, 2 - 2e-13, 1]):
        spectrum = np.array([*spectrum, *[0.0] * (24 - len(spectrum))])
        v = (q * spectrum) @ q.T
        v = (v + v.T) / 2
        values, vectors = whitening.leading(v, 8)
        positive = int((spectrum > 1e-8).sum())
        assert len(values) == min(8, positive)
        assert np.allclose(values, np.sort(spectrum)[::-1][: len(values)], atol=1e-9 * spectrum.max())
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.allclose(v @ vectors, vectors * values, atol=1e-12 * spectrum.max())


def brute_repair(rows):
    """Every list of edits there is, up to two inserts."""
    best, fits = (1 << 30, ""), re.compile(r"(s?(ua)+)?\Z").match

    def go(at, out, letters, cost, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if at == len(rows):
            if fits(out):
                best = min(best, (cost, letters))
        else:
            initial, mark = rows[at]
            go(at + 1, out, letters + "D", cost + 2, inserts)
            if mark != "g":
                more = 5 if mark == "t" else 0
                go(at + 1, out + initial, letters + "K", cost + more, inserts)
                for role in "ua":
                    go(at + 1, out + role, letters + "R", cost + more + 1, inserts)
        if inserts < 2:
            for role in "ua":
                go(at, out + role, letters + "I", cost + 5, inserts + 1)

    go(0, "", "", 0, 0)
    return best


def test_repair_equals_every_list_of_edits():
    chance = random.Random(3)
    for _ in range(250):
        rows = [(chance.choice("sua-"), chance.choice("gt....")) for _ in range(chance.randrange(6))]
        assert conversations.repair("".join(map("".join, rows))) == brute_repair(rows)


def test_cutting_changes_nothing(monkeypatch):
    monkeypatch.setattr(conversations, "_WHOLE", 2)
    chance, cuts = random.Random(5), 0
    for _ in range(400):
        rows = "".join(chance.choice("suauaua-") + chance.choice("gt........") for _ in range(chance.randrange(3, 40)))
        cuts += len(list(conversations._cuts(rows)))
        assert conversations.repair(rows) == conversations._path(rows, "0", "0a")
    assert cuts > 1000


def test_a_very_long_conversation_is_repaired_in_parts():
    chance = random.Random(8)
    rows = "".join(("ua"[k % 2] if chance.random() > 0.08 else chance.choice("sua")) + chance.choice("." * 20 + "gt") for k in range(50_000))
    cost, letters = conversations.repair(rows)
    assert len(letters.replace("I", "")) == 50_000 and cost > 0
    assert conversations.repair("u." * 3001)[0] == 2 + 1500


def brute_conversations(rows):
    said = {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        said[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, own in said.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults, marks = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marks.append({"blank": "g", "duplicate": "g", "truncated": "t", None: "."}[fault])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, letters = brute_repair([((r[1][:1] if r[1][:1] in tuple("sua") else "-"), m) for r, m in zip(own, marks)])
        out, left = [], iter(own)
        for letter in letters:
            row = None if letter == "I" else next(left)
            if letter == "K":
                out.append((row[1], row[2]))
            elif letter in "RI":
                out.append(("assistant" if out and out[-1][0][:1] == "u" else "user", row[2] if row else ""))
        body = "\n".join(f"{r}:{t}" for r, t in out)
        yield conv, gaps, *faults.values(), illegal, cost, letters, hashlib.sha256(body.encode()).hexdigest()


TURNS = "conv_id long, turn long, role string, text string, copies int, first string, digest string"


def some_conversations():
    chance = random.Random(11)
    rows = [(None, 1, "user", "Null id."), (None, None, None, None), (7, None, "user", "Hi."), (7, None, "system", "Be."), (7, 2, "user", "Hi.")]
    for conv in range(120):
        for turn in range(chance.randrange(1, 6)):
            role = chance.choice(["user", "assistant", "user", "assistant", "system", "", None, "Umpire", "user"])
            text = chance.choice(["Yes.", "No!", "cut off", "", "  \t\n", None, "Yes.", "é?", "x. \n", f"{turn}."])
            rows.append((conv, turn * chance.choice([1, 1, 1, 2]), role, text))
            if chance.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_conversations_equal_brute_force(spark):
    rows = some_conversations()
    frame = spark.createDataFrame([(*r, 5, "clash", "d") for r in rows], TURNS).repartition(3)
    got = conversations.repair_conversations(frame).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_conversations(rows)))


def test_conversations_all_dropped_empty_and_long(spark):
    dropped = next(k for k in range(1000) if crc32(f"{k}:0".encode()) % 20 == 0)
    empty_sha = hashlib.sha256(b"").hexdigest()
    frame = spark.createDataFrame([(dropped, 0, "user", "gone.", 1, "f", "d")], TURNS)
    assert [tuple(r) for r in conversations.repair_conversations(frame).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", empty_sha)]
    assert conversations.repair_conversations(frame.where("false")).count() == 0
    long_ = [(1, k, ("user", "assistant")[k % 2], f"{k} " + " " * 200_000 + ("x." if k % 7 else "x"), 1, "f", "d") for k in range(40)]
    long_ += [(2, k, ("user", "assistant")[k % 2], f"{k}.", 1, "f", "d") for k in range(3000)]
    got = {r.conv_id: r for r in conversations.repair_conversations(spark.createDataFrame(long_, TURNS)).collect()}
    assert got[1].truncated > 0 and len(got[2].audit.replace("I", "")) >= 2800


def test_ids_may_be_of_any_type(spark):
    named = spark.createDataFrame([("a", "the cat sat on the mat and token = abcdef0123"), ("b", None), (None, "x")], "doc_id string, text string")
    path, pattern = queries_vocabulary()
    model = quality.fit([], np.array([], np.int64))
    frames = [
        bpe.round_trip(named, path, pattern), secrets.find_secrets(named), simhash.near_duplicates(named), simhash.similar(named),
        language.identify(named, {"en": np.array([1, 2])}), quality.grade_texts(named, model),
        html.extract(named.withColumn("url", F.lit("u")), html="text", row_id="doc_id"),
    ]
    for frame in frames:
        assert sorted(str(r.doc_id) for r in frame.collect()) == ["None", "a", "b"]
        assert frame.schema["doc_id"].dataType.simpleString() == "string"


def queries_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_registered_queries_run_on_given_tables(spark):
    """The thin queries give whole tables; sf0.001 is compared with what brute force makes of the same rows."""
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    five = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    got = queries.op11_url_filters(spark, sf).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((p.page_id, *brute_verdict(p.url, five))) for p in pages)
    said = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    kept = dict(itertools.islice(((c, None) for c in sorted({r.conv_id for r in said})), 15))
    got = [r for r in queries.op13_conversation_repair(spark, sf).collect() if r.conv_id in kept]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_conversations([tuple(r) for r in said if r.conv_id in kept])))
    white = queries.op12_embedding_whitening(spark, sf).collect()
    used, values, _, deviation = brute_white([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])
    assert len(white) == 8 * len(used) and sorted({(r.vec_id, r.deviation) for r in white}) == sorted((i, d) for (i, _), d in zip(used, deviation))
    assert max(r.identity_error for r in white) < 1e-9


def test_secret_rules_take_time_in_proportion():
    """A run of `eyJ` that no token ends is walked once, and the jwt kind still finds tokens."""
    import time

    scanner = secrets.Scanner(secrets.RULES)
    began = time.perf_counter()
    assert scanner.spans([".eyJ " + "eyJ" * 400_000 + " -eyJ" * 100_000]) == [[]]
    assert time.perf_counter() - began < 5
    token = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    assert scanner.spans([f"x {token} y", f"={token}"]) == [[("jwt", 2, 2 + len(token))], [("jwt", 1, 1 + len(token))]]
