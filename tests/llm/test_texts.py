"""Operators on single texts: secrets, html, BPE, licences, language, quality, language model."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from findinglake.llm import bpe, html, language, licenses, lm, quality, secrets, trigrams
from pyspark.sql import functions as F

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def decoder():
    return bpe.Decoder(bpe.load_ranks(PATH))


def test_bpe_equals_the_library(encoder, decoder, library):
    chance = random.Random(3)
    texts = ["", "a" * 5000, "ab" * 3000, " " * 300 + "x", "\n\n \t x", "<|endoftext|>", "it's we'll 'S", "\U0001F600é漢字ß"]
    texts += ["".join(chance.choice("aeth nr\n'1é漢.") for _ in range(chance.randrange(400))) for _ in range(300)]
    texts += ["".join(chr(chance.choice([chance.randrange(0x20, 0x500), chance.randrange(0x2000, 0x3100)])) for _ in range(60)) for _ in range(200)]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
    decoded = decoder.decode([encoder.encode(text) for text in texts] + [None, b""])
    assert decoded.to_pylist() == [text.encode() for text in texts] + [b"", b""]


def plain_merge(ranks, piece):
    """Merge the leftmost pair of the lowest rank, by looking at all pairs each time."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], at) for at, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found or piece in ranks:
            return [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
        _, at = min(found)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_bpe_takes_the_lowest_rank_then_the_leftmost():
    chance = random.Random(1)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 330:
            a, b = (chance.choice(sorted(t for t in tokens if set(t) <= set(b"abc"))) for _ in range(2))
            tokens.add(a + b)
        order = sorted(tokens)
        chance.shuffle(order)
        ranks = dict(zip(order, chance.sample(range(2000), len(order))))
        encoder = bpe.Encoder(ranks, r".+")
        for _ in range(40):
            piece = bytes(chance.choice(b"abc") for _ in range(chance.randrange(1, 40)))
            assert encoder.merge(piece) == plain_merge(ranks, piece)


def test_bpe_memory_is_bounded_and_frequent_tokens_stay(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 4000)
    small = bpe.Encoder(bpe.load_ranks(PATH), PATTERN)
    text = " ".join(f"word{k}x frequentish" for k in range(200)) + "a" * 500
    assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert len(small) + len(small._old) <= 40
    assert " frequentish" in small or " frequentish" in small._old


def test_bpe_unknown_id(decoder):
    for unknown in (999_999, max(bpe.load_ranks(PATH).values()) + 1):
        with pytest.raises(ValueError):
            decoder.decode([np.array([5, unknown], "<u4").tobytes()])


def test_bpe_edges(edge, empty, encoder):
    source = edge.select("doc_id", "text").collect()
    for rows in (bpe.decode(bpe.encode(edge, PATH, PATTERN), PATH), bpe.round_trip(edge, PATH, PATTERN)):
        rows = rows.collect()
        assert sorted((str(r.doc_id), bytes(r.decoded)) for r in rows) == sorted((str(r.doc_id), (r.text or "").encode()) for r in source)
        assert all(len(r.ids) == 4 * r.n_tokens and bytes(r.ids) == encoder.encode(bytes(r.decoded).decode()) for r in rows)
    assert bpe.encode(empty, PATH, PATTERN).count() == bpe.round_trip(empty, PATH, PATTERN).count() == 0


def brute_spans(text):
    found = []
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or ""):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_secrets_equal_brute_force(edge, empty):
    got = secrets.find_secrets(edge).select("doc_id", secrets.of_kinds(F.col("spans"), "assign", "access", "hex").alias("s")).collect()
    want = [(str(r.doc_id), brute_spans(r.text)) for r in edge.select("doc_id", "text").collect()]
    assert sorted((str(r.doc_id), [tuple(s) for s in r.s]) for r in got) == sorted(want)
    assert secrets.find_secrets(empty).count() == 0
    assert secrets.mask_secrets(empty).columns == empty.columns


def test_secrets_random_texts():
    chance, scanner = random.Random(5), secrets.Scanner(secrets.RULES)
    pieces = ["token", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", "\"", "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "zz", "passwd", "Key", "ſecret"]
    texts = ["".join(chance.choice(pieces) for _ in range(chance.randrange(14))) for _ in range(3000)]
    for text, spans in zip(texts, scanner.spans(texts)):
        assert [s for s in spans if s[0] in ("assign", "access", "hex")] == brute_spans(text), text


@pytest.mark.parametrize("text,kind", [
    ("-----BEGIN RSA PRIVATE KEY-----", "private_key"), ("ghp_" + "a1" * 18, "github"), ("xoxb-1234567890-ab", "slack"),
    ("AIza" + "b" * 35, "google"), ("sk_live_" + "c" * 20, "stripe"), ("eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "jwt"),
    ("see https://me:pass1@host", "login"),
])
def test_added_kinds(text, kind):
    spans, = secrets.Scanner(secrets.RULES).spans([text])
    assert kind in [s[0] for s in spans]


def test_masking():
    assert secrets.mask("a token=abcdef b", [("assign", 2, 14)]) == "a [assign] b"
    assert secrets.mask("0123456789", [("assign", 1, 5), ("hex", 3, 7), ("hex", 8, 9)]) == "0[assign]7[hex]9"


@pytest.mark.parametrize("pattern,want", [
    ("abc", b"abc"), ("(?i)ABCD", ("and", (b"abc", b"bcd"))), ("ab", True), ("[a-z]+", True), ("(abc|xyz)", ("or", (b"abc", b"xyz"))),
    ("abc.*xyz", ("and", (b"abc", b"xyz"))), ("(abc)?", True), (r"ab[cd]", ("or", (b"abc", b"abd"))), (r"\x61bc\.d", ("and", (b"abc", b"bc.", b"c.d"))),
])
def test_trigram_queries(pattern, want):
    assert trigrams.trigram_query(pattern) == want


def test_trigram_queries_refuse_what_they_do_not_know():
    with pytest.raises(ValueError):
        trigrams.trigram_query("(?=a)b")


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<nav><a href=x>Home</a></nav>", ""),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>A</a></ul></nav><article><h1>Head</h1><p>One &amp; two<br>three</p><p>Four</article><footer>&copy; x</footer>", "Head\n\nOne & two three\n\nFour"),
    ("<article><p>Text<div class='comments'><p>Reader says hi</div><p>More</article>", "Text\n\nMore"),
    ("<article><p>Cut of<p>by the en", "Cut of\n\nby the en"), ("<article><p>Cut <a href=\"x", "Cut"),
    ("<main><p>A &lt;b&gt; &#233;&amp</p></main>", "A <b> é&"), ("<body><p>Only this.</p>", "Only this."),
    ("<article><script>var t='</p>';</script><p>x<!-- <p>no --></p></article>", "x"),
    ("<article><header><h1>Title</h1></header><form><p>Sign up</p></form><p>Body</p></article>", "Title\n\nBody"),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_main_text_by_density_and_neighbours():
    good = "This is the story of a man who was in the town and it was on the day that he had been with them. " * 3
    menu = "".join(f"<li><a href='/{k}'>Section number {k}</a></li>" for k in range(5))
    page = f"<body><ul>{menu}</ul><div>Short one</div><h2>Heading</h2><div>{good}</div><div>Short two</div><div>{good}</div><ul>{menu}</ul></body>"
    text = " ".join(good.split())
    assert html.main_text(page) == f"Heading\n\n{text}\n\nShort two\n\n{text}"


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<article>é</article>", "y"), (2, "v", "", "z"), (2, "v", "", "z")], "page_id long, url string, html string, text string")
    rows = sorted(html.extract(pages).collect(), key=str)
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in rows] == sorted([(1, None, "", 0), (None, "u", "é", 1), (2, "v", "", 0), (2, "v", "", 0)], key=lambda r: f"Row(page_id={r[0]}")
    assert html.extract(pages.limit(0)).count() == 0


def test_licenses(spark, edge, empty):
    known = [(99, text.upper().replace(" ", "  "), None) for _, text in licenses.KNOWN[:5]]
    known += [(100, "Copyright (c) 2020 Someone\n\n" + licenses.KNOWN[0][1], None), (101, "This work is licensed under Licence.", None)]
    known += [(102, "Some prose.\nReleased under the MIT Licence!\nMore.\n© me\nLicensed under CC BY-NC 4.0", None)]
    rows = licenses.scan(spark.createDataFrame(known, "doc_id long, text string, license string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.license, [tuple(n) for n in r.notices]))
    assert sorted(x for x, _ in by[99]) == sorted(name for name, _ in licenses.KNOWN[:5])
    assert by[100][0][0] == "MIT" and by[101] == [(None, [])]
    assert by[102] == [(None, [(2, "MIT"), (5, "CC-BY-NC-4.0")])]
    assert licenses.scan(edge).count() == edge.count() and licenses.scan(empty).count() == 0
    assert [r.license for r in licenses.scan(edge).where("doc_id = 13").collect()] == ["MIT"]


def brute_grams(text):
    runs = re.sub(r"[^\w]|[\d_]", " ", text.lower()).split()
    found = Counter()
    for run in runs:
        padded = f" {run} "
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                gram = padded[k : k + n]
                if gram != " " and not (n == 3 and gram[1] == " "):
                    found[gram] += 1
    return found


def test_language_grams_equal_brute_force():
    for text in ("Hello, world", "a", "été à la", "x1y2 z_", "the the the"):
        keys, counts = language.counted(language.grams(text))
        got = {"".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s): int(c) for k, c in zip(keys.tolist(), counts)}
        assert got == brute_grams(text)


def test_language_edges(spark, edge, empty):
    learned = spark.createDataFrame([("en", "the cat and the dog with that thing"), ("de", "der hund und die katze mit dem ding"), (None, "x"), ("en", None)] * 3, "lang string, text string")
    profiles = language.learn(learned, F.col("text"), F.col("lang"))
    assert set(profiles) == {"de", "en"}
    rows = language.identify(edge, profiles).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.lang_pred for r in rows if r.doc_id}
    assert by[3] == by[4] == by[5] == by[15] == "und" and by[1] == "en"
    assert language.learn(learned.limit(0), F.col("text"), F.col("lang")) == {}
    assert {r.lang_pred for r in language.identify(edge, {}).collect()} == {"und"}
    assert language.identify(empty, profiles).count() == 0
    tie = language.Judge({"b": profiles["en"], "a": profiles["en"]})
    assert tie.judge("the dog")[0] == "a"


def test_quality_learns_grades(spark, edge, empty):
    chance = random.Random(2)
    words = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for k in range(400):
        text = [chance.choice(words) for _ in range(30)]
        kind = k % 4
        if kind == 0:
            text.insert(5, "insult")
        if kind == 1:
            text = [t + "###" for t in text]
        docs.append((k, " ".join(text)))
        labels.append((k, int(kind != 1), int(kind == 0)))
    labels += [(None, 1, 0), (5000, None, None), (6000, 1, 0)]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(documents, known)
    rows = quality.grade_texts(documents, model).collect()
    assert all(r["keep"] == (r.doc_id % 4 > 1) for r in rows)
    assert all(r.p_fair >= r.p_good and 0 <= r.expected_grade <= 2 for r in rows)
    assert quality.grade_texts(edge, model).count() == edge.count() and quality.grade_texts(empty, model).count() == 0
    kept = quality.select_good(documents, model)
    assert kept.columns == documents.columns and kept.count() == 200
    nothing = quality.learn(documents, known.limit(0))
    assert not nothing.weights.any()
    assert quality.select_good(empty, model).count() == 0


def test_lm_equals_brute_force(edge, empty):
    held_out = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    rows = lm.score_corpus(edge, held_out).collect()
    source = edge.select("doc_id", "text").collect()
    counts = Counter(t for r in source if r.doc_id is None or r.doc_id % 3 for t in lm.tokens((r.text or "").encode()))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), len(ts), sum(counts[t] > 0 for t in ts), round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 4))
                  for r in source for ts in [lm.tokens((r.text or "").encode())])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score <= 0 for r in rows)
    assert lm.score_corpus(empty, held_out).count() == 0
    assert {r.score for r in lm.score_corpus(edge, F.lit(True)).collect()} == {0.0}


def test_lm_is_normalised_and_tail_join_agrees(spark, monkeypatch):
    chance = random.Random(4)
    texts = [" ".join(f"w{int(chance.paretovariate(0.7))}" for _ in range(80)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    held_out = F.col("doc_id") % 5 == 0
    whole = lm.score_corpus(docs, held_out)
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in whole.collect()}
    training = docs.where(~held_out)
    counts = lm.gather(training, head=20)
    assert 0 < len(counts.head) <= 20
    vocabulary = lm.Vocabulary(counts.head)
    model = lm.train(training, vocabulary, rate=1.0)
    rows = lm.score(docs, held_out, counts, vocabulary, model).collect()
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in rows} == want
    places = np.zeros((1, lm.ORDER), np.int64)
    total = sum(10 ** model.log10_class(np.array([k]), places)[0] for k in range(lm.SHORTLIST))
    assert abs(total - 1) < 1e-4


def test_lm_trains_on_every_window(spark):
    texts = ["a b c d", None, "", "a a b"]
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    vocabulary = lm.Vocabulary(lm.gather(training).head)
    model, windows = lm.train(training, vocabulary), [vocabulary.windows(vocabulary.places(lm.tokens((t or "").encode()))) for t in texts]
    one = lm.Model(vocabulary.class_counts)
    trainer = lm.Trainer(one)
    trainer.random.random(sum(len(y) for y, _ in windows))
    trainer.step(np.concatenate([y for y, _ in windows]), np.concatenate([x for _, x in windows]))
    assert all(np.allclose(got, want, atol=1e-5) for got, want in zip(model.parts, one.parts))


def test_lm_reads_slices_of_texts_as_it_reads_each(monkeypatch):
    odd = [bytes(range(256)), None, b"", b" \t ", b" A b\x0bB\x0cb\r\n", b"\xff\xfe \xc3", "É a\u00a0b\u2003c".encode()]
    texts = odd + [b"a  b unknown " * k for k in range(30)] + odd
    each = [lm.tokens(t) for t in texts]
    vocabulary = lm.Vocabulary({b"b": 9, b"a": 7, lm.END: 5, b"\xff\xfe": 1})
    monkeypatch.setattr(lm, "BATCH_CHARS", 100)
    monkeypatch.setattr(lm, "_HELD", 8)
    column = pa.concat_arrays([pa.array([b"cut off"], pa.binary()), pa.array(texts, pa.binary())]).slice(1)
    read = list(vocabulary.read(column))
    assert len(read) > 5
    assert np.concatenate([lengths for lengths, _, _ in read]).tolist() == [len(ts) for ts in each]
    assert np.concatenate([places for _, places, _ in read]).tolist() == [p for ts in each for p in vocabulary.places(ts)]
    assert [t for _, _, others in read for t in others] == [t for ts in each for t in ts if t not in vocabulary]
    got = [vocabulary.windows(places, lengths) for lengths, places, _ in read]
    want = [vocabulary.windows(vocabulary.places(ts)) for ts in each]
    for k in (0, 1):
        assert np.array_equal(np.concatenate([w[k] for w in got]), np.concatenate([w[k] for w in want]))
    counted, batches = Counter(), list(lm.partial_counts(pa.RecordBatch.from_arrays([column], ["text"]) for _ in range(2)))
    for batch in batches:
        counted.update(dict(zip(*(c.to_pylist() for c in batch.columns))))
    assert len(batches) > 1 and counted == Counter(t for ts in each for t in ts for _ in range(2))


def test_lm_scores_without_an_exp_for_each_window_and_class(monkeypatch):
    chance = np.random.default_rng(3)
    classes, before = chance.integers(0, lm.SHORTLIST, 9000), chance.integers(0, lm.SHORTLIST + lm.BUCKETS + 1, (9000, lm.ORDER))
    model = lm.Model(chance.integers(0, 50, lm.SHORTLIST))
    model.parts = [part + chance.normal(0, 0.3, part.shape).astype(np.float32) for part in model.parts]
    want, done, exp = model.log10_by_scores(classes, before), [], np.exp

    def counted(x, *others, **named):
        done.append(np.size(x))
        return exp(x, *others, **named)

    monkeypatch.setattr(np, "exp", counted)
    assert np.allclose(model.log10_class(classes, before), want, atol=1e-5)
    assert sum(done) <= lm.ORDER * lm.SHORTLIST * (lm.SHORTLIST + lm.BUCKETS + 1) < len(classes) * lm.SHORTLIST
    model.parts[0] = model.parts[0] * 60
    got = model.log10_class(classes, before)
    assert np.isfinite(got).all() and np.array_equal(got, model.log10_by_scores(classes, before))


def test_lm_counts_the_end_below_the_threshold(spark):
    texts = [" ".join(["often"] * 40 + ["more"] * 30 + [f"w{k}"]) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held_out = F.col("doc_id") == 5
    training = docs.where(~held_out)
    counts = lm.gather(training, head=2)
    assert counts.head == {b"often": 200, b"more": 150, lm.END: 5}
    vocabulary = lm.Vocabulary(counts.head)
    assert vocabulary.listed_total == 355
    got = lm.score(docs, held_out, counts, vocabulary, lm.Model(vocabulary.class_counts)).collect()
    want = lm.score_corpus(docs, held_out).collect()
    assert {(r.doc_id, r.n_known, round(r.base_score, 6)) for r in got} == {(r.doc_id, r.n_known, round(r.base_score, 6)) for r in want}


@pytest.mark.parametrize("page,want", [
    ("<div class='content with-sidebar'><article><p>One</p></article></div>", "One"),
    ("<div id='main-no-ads'><main><p>One</p></main></div>", "One"),
    ("<div class='social'><article><p>One</p></article></div>", "One"),
    ("<article><section id='related-work'><p>One</p></section><h2 id='notice-period'>Two</h2><p id='related'>Three</p></article>", "One\n\nTwo\n\nThree"),
    ("<article><p>One</p><div class='cookie-bar'><p>No</p></div><div class='box related'>No</div></article><aside><article>No</article></aside>", "One"),
    ("<main><p>One</p></main><div class='comments'><article class='comment-body'><p>No</p></article></div><div hidden><article>No</article></div>", "One"),
])
def test_main_text_by_whole_names(page, want):
    assert html.main_text(page) == want
