"""Operators that compare rows: near-duplicates, decontamination, top-k search, and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import __spark_entry__
import corpus_pipeline
from findinglake.llm import decontaminate, queries, simhash, topk
from pyspark.sql import functions as F


def brute_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parent[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(edge, empty):
    rows = edge.select("doc_id", "text").collect()
    prints = {brute_fingerprint(r.text) for r in rows}
    group = brute_groups(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for r in rows:
        if r.doc_id is not None:
            g = group[brute_fingerprint(r.text)]
            least[g] = min(least.get(g, 1 << 60), r.doc_id)
    want = sorted((str(r.doc_id), f"{brute_fingerprint(r.text):016x}", str(least.get(group[brute_fingerprint(r.text)]))) for r in rows)
    got = simhash.near_duplicates(edge).select("doc_id", simhash.hex_of(F.col("bits")).alias("h"), "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_grid_loses_no_link_and_components_are_right(spark):
    chance = random.Random(9)
    values = {0, (1 << 64) - 1, 7, 1 << 63}
    while len(values) < 400:
        base = chance.choice(sorted(values)) if chance.random() < 0.7 else chance.getrandbits(64)
        for _ in range(chance.randrange(5)):
            base ^= 1 << chance.randrange(64)
        values.add(base)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "bits long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(nodes).collect()}
    want = {tuple(sorted((signed[a], signed[b]))) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 3}
    assert got == want
    group = brute_groups(sorted(signed.values()), lambda a, b: (a, b) in want)
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    inside = {n for pair in want for n in pair}
    least = {}
    for n in inside:
        least[group[n]] = min(least.get(group[n], 1 << 70), n)
    assert roots == {n: least[group[n]] for n in inside}


def test_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(300)}}


def test_similar_groups_near_copies_and_nothing_else(spark, empty):
    chance = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    docs = [[chance.choice(words) for _ in range(300)] for _ in range(40)]
    rows, truth = [], {}
    for k, doc in enumerate(docs):
        for copy in range(3):
            changed = list(doc)
            for _ in range(2 * copy):
                changed[chance.randrange(len(changed))] = chance.choice(words)
            rows.append((10 * k + copy, " ".join(changed)))
            truth[10 * k + copy] = 10 * k
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The sketches decide near 0.8 by estimate: few copies may be missed, and no text joins another group.
    assert all(got[k] // 10 == k // 10 for k in truth)
    assert sum(got[k] == truth[k] for k in truth) >= 0.97 * len(truth)
    assert simhash.similar(empty).count() == 0


def brute_similar(rows):
    def grams(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    found = {k: grams(text) for k, text in rows}
    group = brute_groups(sorted(found), lambda a, b: 9 * len(found[a] & found[b]) >= 4 * (len(found[a]) + len(found[b])))
    least = {}
    for k in sorted(group):
        least.setdefault(group[k], k)
    return {k: least[g] for k, g in group.items()}


def groups_of(spark, rows):
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return {r.doc_id: r.component_id for r in got}


def test_similar_finds_appended_cut_and_scattered_copies(spark):
    chance = random.Random(12)
    words = [f"w{k}" for k in range(2000)]
    rows = []
    for k in range(60):
        doc = [chance.choice(words) for _ in range(chance.randrange(60, 400))]
        share = chance.choice((0.05, 0.1, 0.15, 0.19))
        more = [chance.choice(words) for _ in range(int(share * len(doc)))]
        scattered = list(doc)
        for _ in range(max(1, int(share * len(doc) / 10))):
            scattered[chance.randrange(len(doc))] = chance.choice(words)
        texts = [doc, doc + more, doc[: len(doc) - len(more)], scattered]
        rows += [(10 * k + j, " ".join(text)) for j, text in enumerate(texts)]
    want = brute_similar(rows)
    assert len(set(want.values())) < 90
    assert groups_of(spark, rows) == want


def test_similar_leaves_texts_under_the_threshold_apart(spark):
    chance = random.Random(13)
    words = [f"w{k}" for k in range(2000)]
    line = " ".join(words[:12])
    rows = []
    for k in range(60):
        doc = [chance.choice(words) for _ in range(300)]
        changed = list(doc)
        for at in range(0, 300, 30):
            changed[at] = "changed"
        # 46 to 50 of 296 shingles differ: about 0.71 of all are shared.
        rows += [(10 * k, " ".join(doc)), (10 * k + 1, " ".join(changed))]
    rows += [(1000 + k, f"{line} " * 40 + " ".join(chance.choice(words) for _ in range(40))) for k in range(5)]
    want = brute_similar(rows)
    assert all(want[k] == k for k in want)
    assert groups_of(spark, rows) == want


def test_similar_decides_every_member_of_a_large_group(spark):
    chance = random.Random(14)
    doc = [f"w{k}" for k in range(200)]
    rows = [(500, " ".join(doc))]
    for k in range(120):
        version = list(doc)
        at = chance.randrange(5, 160)
        version[at : at + 14] = version[at : at + 14][::-1]
        rows.append((k, " ".join(version)))
    # The same words in another order: close to each other only.
    mixed = chance.sample(doc, len(doc))
    rows += [(600, " ".join(mixed)), (601, " ".join([*mixed[10:], *mixed[:10]]))]
    want = brute_similar(rows)
    assert sorted(set(want.values())) == [0, 600]
    assert groups_of(spark, rows) == want


def oracle_rows(name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        con.register(table, frame)
    return con.sql(queries.ORACLES[name]).fetchall()


BENCH = [
    (1, "jumps over the lazy dog and then it runs back to the river"), (2, "jumps over the lazy dog and then it runs back to the river"),
    (3, "lazy dog"), (4, ""), (5, None), (None, "fox jumps over the lazy dog and then it runs back"), (6, "w5 w6 w7 w8 w9 W10 w11, w12 w13 w14 w15"),
    (7, "same same same same same same same same same same same"), (8, "x"),
]


def test_decontamination_equals_sql(spark, edge, empty, edge_rows):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.contamination(edge, bench)
    cols = ["doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256), F.col("n_hit") > 0]
    rows = sorted(map(str, map(tuple, got.select(*cols).collect())))
    frame = pd.DataFrame({"doc_id": pd.array([r[0] for r in edge_rows], "Int64"), "text": [r[1] for r in edge_rows]})
    items = pd.DataFrame({"item_id": pd.array([b[0] for b in BENCH], "Int64"), "text": [b[1] for b in BENCH]})
    assert rows == sorted(map(str, oracle_rows("op7_benchmark_decontamination", documents=frame, benchmark=items)))
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(edge, bench.limit(0)).collect()} == {0}


def test_winnowing_finds_every_shared_window(spark):
    chance = random.Random(8)
    words = ["a", "b", "c"]
    docs = [(k, " ".join(chance.choice(words) for _ in range(60))) for k in range(60)]
    items = [(k, " ".join(chance.choice(words) for _ in range(14))) for k in range(400)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    windows = {}
    for k, text in items:
        w = text.split()
        for s in range(len(w) - 9):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(k)
    for r in got.collect():
        w = docs[r.doc_id][1].split()
        starts = [s for s in range(len(w) - 9) if tuple(w[s : s + 10]) in windows]
        assert [s.start for s in r.spans] == starts
        assert r.n_hit == len({p for s in starts for p in range(s, s + 10)})
        assert set(r["items"]) == {str(k) for s in starts for k in windows[tuple(w[s : s + 10])]}


def test_top_k_equals_brute_force(spark):
    chance = np.random.default_rng(3)
    vectors = chance.normal(0, 1, (300, 24)).round(1)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 24), (303, [float("inf")] * 24), (None, rows[0][1]), (304, [2.0]), (305, []), (306, rows[1][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk.search(df, F.col("vec_id") % 50 == 0).collect()
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for qi, q in usable:
        if qi % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in usable if i != qi)[:5]
            want += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_prune_without_loss():
    chance = np.random.default_rng(4)
    for scale in (1, 10**9):
        points = (chance.normal(0, 60, (64, 500)) * np.linspace(3, 0.1, 64)[:, None]).astype(np.int64) * scale
        queries_ = points[:, :10]
        ids = np.arange(500)
        rows, found, scores = topk.best_of_block(queries_, ids[:10], points, ids, 5)
        for k in range(10):
            all_scores = queries_[:, k] @ points
            order = [i for i in np.lexsort((ids, -all_scores)) if i != k][:5]
            assert found[rows == k].tolist() == order and scores[rows == k].tolist() == all_scores[order].tolist()


def test_registered_queries():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "decontamination", "secrets", "encoding"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_edges(spark, tmp_path, edge, empty, stage):
    spark.createDataFrame([(1, 1, 0), (7, 0, 0), (14, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert len(rows) <= docs.count() and stage(spark, empty.select(docs.columns), str(tmp_path)).count() == 0
    if stage is not corpus_pipeline.encode:
        assert out.columns == docs.columns
    if stage is corpus_pipeline.mask_secrets:
        assert not any("hunter2" in (r.text or "") for r in rows) and len(rows) == docs.count()
    if stage is corpus_pipeline.drop_near_duplicates:
        ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
        assert ids == [1, 2, 3, *range(6, 17)] and not any(r.doc_id is None for r in rows)
    if stage is corpus_pipeline.cut_benchmark:
        kept = {r.doc_id for r in rows}
        assert not kept & {1, 9, 10, 11, 16} and {2, 3, 4, 6, 7} <= kept
    if stage is corpus_pipeline.encode:
        texts = {(str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
        assert {(str(r.doc_id), r.decoded_sha256) for r in rows} == texts


def test_pipeline_drops_what_simhash_links_and_nothing_else(spark):
    chance = random.Random(21)
    docs = [" ".join(f"w{chance.randrange(4000)}" for _ in range(400)) for _ in range(30)]
    rows = [(2 * k, text) for k, text in enumerate(docs)]
    # Every second text has a longer version: over 0.8 of five-word shingles are shared, yet most fingerprints are far apart.
    rows += [(2 * k + 1, docs[k] + " " + " ".join(f"v{chance.randrange(4000)}" for _ in range(30))) for k in range(0, 30, 2)]
    rows += [(100 + k, docs[k].upper()) for k in range(5)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    group = brute_groups({brute_fingerprint(t) for _, t in rows}, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for i, t in sorted(rows):
        least.setdefault(group[brute_fingerprint(t)], i)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert kept == sorted(least.values()) and len(kept) > 30 and not set(kept) & set(range(100, 105))
