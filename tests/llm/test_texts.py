"""Token counts, media, classifiers, packing and the pipeline."""

import hashlib
import json
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from orrery.llm import boosting, language_id, media, packing, quality_classifier, token_counts
from orrery.llm.queries import QUERIES
from orrery.llm.tokens import default_vocabulary, vocabulary

ODD = [None, "", "\n", "a", "line one\nline two\n\n\n  x", "naïve 😀😀 текст\n中文字符\n", "a<|endoftext|>b", "z" * 9000, "don't  stop\t\t now", "²½ 12٣ _x_ … ​"]


@pytest.fixture(scope="module")
def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: made.encode(text or "", add_special_tokens=False)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_ids_equal_the_tokenizer_library(reference_ids, texts):
    vocab = vocabulary(default_vocabulary())
    for text in [*ODD, *list(texts.values())[:100]]:
        assert vocab.ids(text or "").tolist() == reference_ids(text).ids


def odd(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(ODD)] + [(4, ODD[4], "s"), (None, "null id", "s")], "doc_id long, text string, section string")


def owners(encoded, spans, rule):
    """Tokens of each section, token by token, from the tokenizer library's character offsets."""
    out = Counter()
    for a, b in encoded.offsets:
        shared = [(max(0, min(b, y) - max(a, x)), k) for k, (x, y) in enumerate(spans)]
        among = [k for n, k in shared if n]
        most = max(n for n, _ in shared)
        out[{"first": among[0], "last": among[-1], "most": next(k for n, k in shared if n == most)}[rule]] += 1
    return [out[k] for k in range(len(spans))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_equal_offsets(spark, reference_ids, texts, rule):
    more = ["a\n\n\n\nb \n \n\n c", "éé\n中文\n\n😀\n", "\n" * 50, "x\r\n\r\n\r\ny", *list(texts.values())[:40]]
    docs = odd(spark).union(spark.createDataFrame([(100 + i, t, "s") for i, t in enumerate(more)], odd(spark).schema))
    rows = defaultdict(list)
    for r in token_counts.section_tokens(docs, rule).collect():
        assert r.field == "text"
        rows[r.doc_id].append(r)
    for i, text in [*enumerate(ODD), *enumerate(more, 100)]:
        found = sorted({(r.section, r.start, r.end, r.n_tokens, r.doc_tokens) for r in rows[i]})
        text = text or ""
        spans = [(m.start(), m.end()) for m in re.finditer("[^\n]*\n|[^\n]+", text)] or [(0, 0)]
        assert [(a, b) for _, a, b, _, _ in found] == spans
        assert sum(f[3] for f in found) == len(reference_ids(text).ids) == found[0][4]
        assert [f[3] for f in found] == owners(reference_ids(text), spans, rule), text
    assert len(rows[4]) == 2 * len({r.section for r in rows[4]})
    assert token_counts.section_tokens(odd(spark).limit(0)).count() == 0


def test_tokens_of_several_fields(spark, reference_ids):
    docs = spark.createDataFrame([(1, "Title 😀", "body\ntext\n", 5), (2, None, None, None), (3, "", "x", 7)], "doc_id long, title string, text string, field int")
    found = {}
    for r in token_counts.section_tokens(docs, fields=("title", "text", "field")).collect():
        found[r.doc_id, r.field, r.section] = (r.start, r.end, r.n_tokens, r.doc_tokens)
    document = "Title 😀\nbody\ntext\n\n5"
    spans = [(0, 8), (8, 13), (13, 19), (19, 20)]
    want = owners(reference_ids(document), spans, "most")
    got = [found[1, *k] for k in (("title", 0), ("text", 0), ("text", 1), ("field", 0))]
    assert [g[:2] for g in got] == spans and [g[2] for g in got] == want and {g[3] for g in got} == {sum(want)}
    assert [found[2, f, 0][:2] for f in ("title", "text", "field")] == [(0, 1), (1, 2), (2, 2)] and found[2, "field", 0][2] == 0
    assert sum(v[2] for k, v in found.items() if k[0] == 3) == len(reference_ids("\nx\n7").ids)


def test_boundary_rules():
    # Three tokens of 3, 4 and 2 characters over sections that begin at 0, 4, 4 (an empty one) and 8.
    first, last, starts = np.array([0, 3, 7]), np.array([2, 6, 8]), np.array([0, 4, 4, 8])
    assert token_counts.allocate(first, last, starts, "first").tolist() == [2, 0, 1, 0]
    assert token_counts.allocate(first, last, starts, "last").tolist() == [1, 0, 1, 1]
    assert token_counts.allocate(first, last, starts, "most").tolist() == [1, 0, 2, 0]


def test_media_round_trip(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_002, "\n"), (None, "x")], "doc_id long, text string")
    rows = media.media_columns(docs).collect()
    assert len(rows) == docs.count()
    by_text = defaultdict(set)
    for r in rows:
        text = "x" if r.doc_id is None else texts[r.doc_id] if r.doc_id < 10_000 else ODD[r.doc_id - 10_000]
        raw = (text or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert r.error is None and (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        image = media.encode_png(raw)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        by_text[text or ""].add(r.feature)
    assert all(len(f) == 1 for f in by_text.values())
    assert media.media_columns(docs.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "same", "a", "b")] * 2 + [(2, "long " * 100_000, "c", "d")], "doc_id long, text string, media string, error string")
    found = media.media_columns(again).collect()
    assert sorted(r.doc_id for r in found) == [1, 1, 2] and len({r.media_sha256 for r in found}) == 2


def test_media_damaged_members_fail_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(50)], "doc_id long, text string").coalesce(1)
    uri = media.store(docs)
    assert uri.startswith("file:///")
    folder = uri.removeprefix("file://")
    import glob

    (path,) = glob.glob(f"{folder}/*.zip")
    rows = media.load(spark, uri, 2000).collect()
    assert media.load(spark, uri, 2000).rdd.getNumPartitions() >= 3
    bad = next(r for r in rows if r.name.startswith("7/"))
    with open(path, "r+b") as file:
        file.seek(bad.offset + 60)
        file.write(b"\0\0\0")
    found = media.features(media.load(spark, uri, 2000)).collect()
    assert len(found) == 50 and [r.doc_id for r in found if r.error] == ["7"]


def test_media_damaged_archives_and_directories(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(90)], "doc_id long, text string").repartitionByRange(3, "doc_id")
    uri = media.store(docs)
    folder = uri.removeprefix("file://")
    with open(f"{folder}/{media.MANIFEST}") as file:
        archives = [media.Archive(*a) for a in json.load(file)]
    assert len(archives) == 3
    sizes = Counter(r.archive for r in media.load(spark, uri, 2000).collect())
    # One archive is lost; of another the directory has a hole near its end.
    with open(f"{folder}/{archives[0].name}", "wb"):
        pass
    with open(f"{folder}/{archives[1].name}", "r+b") as file:
        file.seek(archives[1].at + archives[1].size - 70)
        file.write(b"\0" * 40)
    for split in (2000, 1 << 30):
        rows = media.features(media.load(spark, uri, split)).collect()
        whole = [r for r in rows if r.error is None]
        assert sizes[archives[2].name] + 20 <= len(whole) < 90 - sizes[archives[0].name]
        assert any(r.error and r.doc_id is None for r in rows)


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_parts_of_a_directory_have_each_entry_once(tmp_path, method):
    """Names that hold the signature of an entry, comments, and parts of any size."""
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", method) as archive:
        for i in range(200):
            info = zipfile.ZipInfo(f"{i}PK\1\2{'x' * (i % 50)}")
            info.comment, info.compress_type = b"PK\1\2" * (i % 5), method
            archive.writestr(info, f"body {i} " * 9)
        archive.comment = b"end" * 500
    with pa.OSFile(str(path)) as file:
        held = media.Archive("a", *media.directory(file))
        for parts in (1, 2, 7, 100, 3000):
            cuts = [held.at + held.size * k // parts for k in range(parts + 1)]
            found = [e for lo, hi in zip(cuts, cuts[1:], strict=False) for e in media.entries(file, held, lo, hi)]
            assert [e.name.split(b"PK")[0] for e in found] == [b"%d" % i for i in range(200)]
        assert media.read_member(file, found[7]) == b"body 7 " * 9


def test_member_is_retried():
    class Flaky:
        def __init__(self, data, failures):
            self.data, self.failures, self.at = data, failures, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            if self.failures:
                self.failures -= 1
                raise OSError("lost")
            out = self.data[self.at : self.at + n]
            self.at += n
            return out

    body = b"payload"
    data = b"PK\x03\x04" + b"\0" * 22 + b"\x01\0\0\0" + b"n" + body
    member = media.Entry(0, len(body), len(body), zlib.crc32(body), 0, b"n")
    assert media.read_member(Flaky(data, 2), member, pause=0) == body
    with pytest.raises(OSError):
        media.read_member(Flaky(data, 3), member, pause=0)


def test_boosted_trees_learn_and_equal_row_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:1500], y[:1500])
    score = model.score(x[1500:])
    assert ((score > 0.5) == y[1500:]).mean() > 0.95
    row, total = x[1500], model.base
    for feature, limit, value in zip(model.feature, model.limit, model.value, strict=True):
        k = 0
        while k < len(feature):
            k = 2 * k + 1 + int(row[feature[k]] > limit[k])
        total += value[k - len(feature)]
    assert abs(1 / (1 + np.exp(-total)) - score[0]) < 1e-12
    assert boosting.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert (boosting.fit(x[:9], np.ones(9)).score(x[:3]) > 0.9).all()


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_quality_classifier"](spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.95
    assert len({r.predicted for r in test}) == 2


def test_quality_classifier_edges(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, None, "x"), (3, 1, "x"), (3, 0, "y"), (None, 1, "z")], "doc_id long, quality int, text string")
    model = quality_classifier.train(docs, labels)
    assert len(quality_classifier.classify(docs, model).collect()) == docs.count()
    assert quality_classifier.classify(docs.limit(0), model).count() == 0
    assert quality_classifier.train(docs, labels.limit(0)).score(np.zeros((1, 1))).tolist() == [0.5]
    assert len({len(quality_classifier.statistics(t)) for t in ODD}) == 1
    # Repeated rows, a very long text, a column named like a new one: one score a row, equal ones for equal texts.
    more = spark.createDataFrame([(1, "a b c", 0.5), (1, "a b c", 0.7), (2, "word " * 60_000, 0.1), (None, None, None)], "doc_id long, text string, score double")
    scores = quality_classifier.classify(more, model).collect()
    assert len(scores) == 4 and len({r.score for r in scores if r.doc_id == 1}) == 1
    # Of repeated ids one text teaches, always the same.
    twice = spark.createDataFrame([(1, "good", "x"), (1, "other", "x"), (3, "bad", "x")], "doc_id long, text string, score string")
    held = lambda d: sorted(tuple(r) for r in quality_classifier.training_rows(d, spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, quality int")).collect())
    assert len(held(twice)) == 2 and held(twice) == held(twice.orderBy("text").repartition(3))


def plain_statistics(text):
    """The same numbers, counted one by one."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, chars, lengths = max(1, len(words)), max(1, len(raw)), [len(w) for w in words] or [0]
    of = lambda test: sum(map(test, raw)) / chars
    listed = [of(lambda b, c=c: b in c) for c in quality_classifier._CLASSES]
    held = b"".join(quality_classifier._CLASSES)
    upper, lower, wide = of(lambda b: 65 <= b <= 90), of(lambda b: 97 <= b <= 122), of(lambda b: b >= 128)
    other = of(lambda b: b < 128 and b not in held and not (65 <= b <= 90 or 97 <= b <= 122))
    mean = sum(lengths) / len(lengths)
    symbols = b"#*$%&|<>!"
    size, extra = divmod(len(raw), 8)
    cuts = [0]
    for k in range(8):
        cuts.append(cuts[-1] + size + (k < extra))
    parts = [sum(b in symbols for b in raw[a:b_]) / (b_ - a) if b_ > a else 0.0 for a, b_ in zip(cuts, cuts[1:], strict=False)]
    before = sum(a in symbols and b in b"\n \t\r\x0b\x0c" for a, b in zip(raw, raw[1:], strict=False))
    return [
        np.log1p(len(words)), np.log1p(len(raw)), mean, (sum((x - mean) ** 2 for x in lengths) / len(lengths)) ** 0.5, max(lengths),
        *listed, upper, lower, wide, other, len(set(words)) / n, max(Counter(words).values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(w.isupper() for w in words) / n,
        before / n, len(lines) / n, len(set(lines)) / max(1, len(lines)), max(parts), min(parts),
    ]


def test_statistics_equal_plain_python(texts):
    for text in [*ODD, *list(texts.values())[:60]]:
        assert np.allclose(quality_classifier.statistics(text), plain_statistics(text)), text


def test_first_tree_equals_plain_search():
    """The best split of one level, over all features and limits, from sums of gradients row by row."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=300) > 6).astype(float)
    model = boosting.fit(x, y, boosting.Options(trees=1, depth=1))
    p = (y.sum() + 0.5) / 301
    grad, hess = p - y, np.full(300, p * (1 - p))
    part = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1)
    best = max(((part(x[:, f] <= c) + part(x[:, f] > c), f, c) for f in range(3) for c in range(11)), key=lambda t: t[0])
    f, limit = int(model.feature[0][0]), model.limit[0][0]
    left = x[:, f] <= limit
    assert abs(part(left) + part(~left) - best[0]) < 1e-9
    for side, value in zip((left, ~left), model.value[0], strict=True):
        assert abs(value + 0.15 * grad[side].sum() / (hess[side].sum() + 1)) < 1e-12


def test_language_id_held_out(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.97


def plain_model(rows):
    """Counts of words and n-grams by language and order, as dictionaries."""
    docs, counts = Counter(), defaultdict(Counter)
    for lang, text in rows:
        docs[lang] += 1
        for w in language_id.words(text):
            counts[0][lang, w] += 1
            for n in language_id.ORDERS:
                for g in language_id.grams(w, n):
                    counts[n][lang, g] += 1
    return docs, counts


def plain_total(docs, counts, text):
    """Log probability of each language, word by word."""
    languages, out = sorted(docs), []
    vocab = {n: {e for _, e in c} for n, c in counts.items()}
    for x in languages:
        size = {n: sum(v for (y, _), v in c.items() if y == x) for n, c in counts.items()}
        log = lambda n, e: np.log((counts[n][x, e] + 0.5) / (size[n] + 0.5 * len(vocab[n])))
        total = np.log((docs[x] + 0.5) / (sum(docs.values()) + 0.5 * len(languages)))
        for w in language_id.words(text):
            if w in vocab[0]:
                total += log(0, w)
                continue
            for n in language_id.ORDERS:
                known = [g for g in language_id.grams(w, n) if g in vocab[n]]
                if known:
                    total += np.mean([log(n, g) for g in known])
                    break
        out.append(total)
    return out


@pytest.mark.parametrize("memory", [1, 1_000_000])
def test_language_id_equals_plain_python(spark, sf_dir, monkeypatch, memory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model, plain = language_id.train(docs), plain_model([(r.lang, r.text) for r in rows if r.lang and r.text])
    assert model.languages == sorted(plain[0])
    monkeypatch.setattr(language_id, "MEMORY", memory)
    texts = [r.text for r in docs.collect()[:20]] + ["schlafender kätzchen", "", "unseenish wordlike", "qqqq ййй", "the the the"]
    for _ in range(2):
        for text, total in zip(texts, model.totals([language_id.words(t) for t in texts]), strict=True):
            assert np.allclose(total, plain_total(*plain, text), rtol=1e-4)


def test_language_id_backoff_and_edges(spark):
    rows = [(i, "the cat sat on the mat and the hat", "en", 0) for i in range(20)] + [(100 + i, "der hund und die katze schlafen", "de", 0) for i in range(20)]
    rows += [(300, None, "en", 0), (301, "12 + 3 ²", "en", 0), (302, "text", None, 0), (None, "the", "de", 0), (303, "hund " * 40_000, None, 0), (0, "the cat", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.train(docs)
    assert model.languages == ["de", "en"]
    assert model.totals([["schlafender"]]).argmax() == 0 and model.lines(["schlafender", "qqqqq", "und"])[1].tolist() == [5, -1, 0]
    found = language_id.identify(docs, model).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert got[0][0] == "en" and got[100][0] == got[303][0] == "de" and got[300] == got[301] == ("und", 0.0)
    # A tie: the first by name.
    even = spark.createDataFrame([(1, "abc", "y"), (3, "abc", "x")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(even, language_id.build(["x", "y"] * 2, np.array([-1, -1, 0, 0]), ["", "", "abc", "abc"], np.ones(4))).collect()} == {"x"}
    empty = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def first_fit(lengths, capacity):
    gaps, placed = [], []
    for size in sorted(lengths, reverse=True):
        fitting = [(g, k) for k, g in enumerate(gaps) if g >= size]
        k = min(fitting)[1] if fitting else len(gaps)
        if not fitting:
            gaps.append(capacity)
        gaps[k] -= size
        placed.append(k)
    return len(gaps)


@pytest.mark.parametrize("seed,capacity", [(1, 10), (2, 64), (3, 1024)])
def test_plan_is_best_fit_decreasing(seed, capacity):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        lengths = np.minimum(capacity, 1 + rng.geometric(rng.choice([2.0, 5.0, 9.0]) / capacity, rng.integers(0, 400)))
        counts = Counter(lengths.tolist())
        plan = packing.Plan(counts, capacity)
        assert plan.sequences == first_fit(lengths.tolist(), capacity)
        seats = defaultdict(list)
        for size, n in counts.items():
            for s, o in zip(*plan.seat(size, np.arange(n)), strict=True):
                seats[int(s)].append((int(o), size))
        for places in seats.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= capacity


def check_packing(rows, texts, ids_of, capacity=1024):
    seats, found = defaultdict(list), defaultdict(list)
    for r in rows:
        seats[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id].append(r)
    for places in seats.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
    for i, text in texts.items():
        ids, own = [*ids_of(text).ids, 2], sorted(found.pop(i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // capacity) and all(r.length == capacity for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert not found
    return len(seats), -(-sum(r.length for r in rows) // capacity)


def test_packing_round_trip(spark, sf_dir, texts, reference_ids):
    used, least = check_packing(QUERIES["op10_best_fit_packing"](spark, sf_dir).collect(), texts, reference_ids)
    assert used <= 1.02 * least + 1


def test_packing_edges(spark, reference_ids):
    rows = packing.pack(odd(spark)).collect()
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert packing.pack(odd(spark).limit(0)).count() == 0
    exact = spark.createDataFrame([(1, "a" + " a" * 1022), (2, "a" + " a" * 1023), (3, None)], "doc_id long, text string")
    check_packing(packing.pack(exact).collect(), {r.doc_id: r.text for r in exact.collect()}, reference_ids)


def test_pipeline_equals_its_plain_form(spark, sf_dir, reference_ids):
    from test_native import base, spans
    from test_near_duplicates import brute

    from orrery.llm.shared import settled

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    kept = settled(stage["quality_rules"](spark, docs, sf_dir), "t")
    good = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns
    for i, r in raw.items():
        n, _, symbols, _, again = base(r.text)
        failed = n < 50 or 100 * again > 50 * n
        assert not (failed and i in good)
        assert i in good or failed or symbols > 0.1 * n or r.text.upper()[:200] == r.text[:200]
    one = settled(stage["ngram_jaccard_join"](spark, kept, sf_dir), "t")
    want = {i for i, (_, c) in brute(list(good), list(good.values()), 5, 80, 100).items() if i == c}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    clean = settled(stage["pii"](spark, one, sf_dir), "t")
    for r in clean.collect():
        assert not spans(r.text) and r.n_chars == len(r.text)
        if not spans(raw[r.doc_id].text) and "[TERM]" not in r.text:
            assert r.text == raw[r.doc_id].text
    order = stage["mixing"](spark, clean, sf_dir)
    assert order.columns == docs.columns and sorted(r.doc_id for r in order.collect()) == sorted(want)
    last = {r.doc_id: r.text for r in clean.collect()}
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), last, reference_ids)


def lead(spark, docs, mixes):
    """How far one source of two equal ones gets ahead of the other over the sequences, in tokens."""
    from orrery.llm.shared import settled

    stage = dict(corpus_pipeline.STAGES)
    docs = settled(stage["mixing"](spark, docs, ""), "t") if mixes else settled(docs, "t")
    tokens = defaultdict(lambda: [0, 0])
    for r in stage["best_fit_packing"](spark, docs, "").collect():
        tokens[r.sequence_id][r.doc_id >= 10_000] += r.length
    assert sorted(tokens) == list(range(len(tokens))) and sum(map(sum, tokens.values())) == 2000 * 600 + 2400 * 500
    return abs(np.cumsum([tokens[s][0] - tokens[s][1] for s in range(len(tokens))])).max()


def test_pipeline_sequences_hold_the_target_shares(spark):
    """Without the mixing stage the sources follow one another."""
    docs = [(i, "a" + " a" * 598, "long") for i in range(2000)] + [(10_000 + i, "a" + " a" * 498, "short") for i in range(2400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    # Both sources have as many characters; a window has some 280,000 tokens.
    assert lead(spark, df, True) < 300_000 < 900_000 < lead(spark, df, False)


def test_pack_in_order_of_any_table(spark, reference_ids):
    rows = packing.pack_in_order(odd(spark), window=3).collect()
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
    assert packing.pack_in_order(odd(spark).limit(0)).count() == 0
    named = spark.createDataFrame([(1, "text", "mine", 7)], "doc_id long, text string, _metadata string, _at int")
    assert packing.pack_in_order(named).count() == 1


def odd_documents(spark):
    good = " ".join(f"the word{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(60))
    other = " ".join(f"of thing{chr(97 + i % 26)}{chr(97 + i // 26)} and" for i in range(60)) + " write to a.b@mail.example"
    long = " ".join(f"the part{i // 676 % 26}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}x{i} of" for i in range(20_000))
    rows = [(1, good, "en", "a"), (1, good, "en", "a"), (2, good, None, None), (3, None, "en", "a"), (4, "", "en", "b"), (5, other, "de", "b"), (None, other + " more", "de", "b"), (6, long, "xx", "c"), (7, " \n\t ", None, "c")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, quality string, component_id int, pii string, mix_slot int, row string, _part int, _window string"
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "q", 5, "p", 9, "r", 3, "w") for r in rows], shape)


def test_pipeline_stages_on_odd_documents(spark):
    """Null, empty, blank, repeated and very long texts, null ids and sources, and columns named like those that operators make."""
    docs, stage = odd_documents(spark), dict(corpus_pipeline.STAGES)
    want = {"quality_rules": [None, 1, 1, 2, 5, 6], "ngram_jaccard_join": [1, 3, 4, 5, 6, 7], "pii": [None, 1, 1, 2, 3, 4, 5, 6, 7], "mixing": [None, 1, 1, 2, 3, 4, 5, 6, 7]}
    for name, ids in want.items():
        out = stage[name](spark, docs, "")
        rows = out.collect()
        assert out.columns == docs.columns and sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i)) == ids, name
        assert all((r.quality, r.component_id, r.pii, r.mix_slot, r.row) == ("q", 5, "p", 9, "r") for r in rows)
        empty = stage[name](spark, docs.limit(0), "")
        assert empty.columns == docs.columns and empty.count() == 0
        if name == "pii":
            texts = {r.doc_id: r.text for r in rows}
            assert texts[3] is None and texts[4] == "" and texts[5].endswith("write to [EMAIL]")
    pieces = stage["best_fit_packing"](spark, docs, "").collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter([None, 1, 1, 2, 3, 4, 5, 6, 7])
    assert sum(r.length for r in pieces if r.doc_id in (3, 4)) == 2 and sum(r.doc_id == 6 for r in pieces) > 50
    assert stage["best_fit_packing"](spark, docs.limit(0), "").count() == 0


def test_operators_on_odd_documents(spark):
    from orrery.llm import near_duplicates, quality_rules

    docs = odd_documents(spark)
    assert len(near_duplicates.near_duplicates(docs).collect()) == 9
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()}[2] == 1
    assert len(packing.pack(docs).collect()) > 60 and packing.pack(docs.limit(0)).count() == 0
    assert len(quality_rules.verdicts(docs).collect()) == 9
    assert token_counts.section_tokens(docs, fields=("source", "text")).select("doc_id", "field").distinct().count() == 16
    assert len(media.media_columns(docs).collect()) == 9
    assert len(language_id.identify(docs, language_id.train(docs)).collect()) == 9


def test_lists_survive_arrow_slices():
    from orrery.llm.near_duplicates import _groups

    batch = pa.RecordBatch.from_pydict({"h": [1, 1, 2, 2, 2, 3], "v": list(range(6))})
    parts = [batch.slice(0, 1), batch.slice(1, 2), batch.slice(3, 0), batch.slice(3, 3)]
    groups = [t.column("h").to_pylist() for t in _groups(iter(parts), ["h"])]
    assert sum(groups, []) == [1, 1, 2, 2, 2, 3]
    assert all(set(a).isdisjoint(b) for i, a in enumerate(groups) for b in groups[:i])
