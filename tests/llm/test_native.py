"""Quality rules, mixing, URL filters and personal data against plain Python."""

import hashlib
import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing, pii, quality_rules, url_filters
from orrery.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_equal_plain_python(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op1_quality_rules"](spark, sf_dir).collect():
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_edges(spark):
    texts = [None, "", " \n\t", "a a a a", "x " * 30_000, "ä b 😀", "l\nl\n\nl"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    rows = quality_rules.verdicts(docs).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == base(r.text)
        assert not q.kept
    assert quality_rules.verdicts(docs.limit(0)).count() == 0


def test_quality_sql_is_the_table(spark):
    """Every rule of the table stands in the SQL."""
    from orrery.llm.queries import OP1_SQL

    assert all(r.measure.split(" / ")[0] in OP1_SQL for r in quality_rules.RULES) and [r.base for r in quality_rules.RULES[:3]] == [True, True, False]


def test_quality_keeps_columns(spark):
    good = " ".join(f"the word{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(40))
    docs = spark.createDataFrame([(1, good, "q"), (2, "bad", "q")], "doc_id long, text string, quality string")
    assert [(r.doc_id, r.quality) for r in quality_rules.keep(docs).collect()] == [(1, "q")]
    assert quality_rules.keep(docs).columns == docs.columns


def test_quality_judges_stop_words_of_known_languages_only(spark):
    russian = " ".join(f"слово{chr(1072 + i % 30)}{chr(1072 + i // 30)} и ещё" for i in range(160))
    english = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} thing" for i in range(160))
    docs = spark.createDataFrame([(1, russian, "ru"), (2, russian, None), (3, english, "en"), (4, english, "sw"), (5, "x " * 200_000, "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.quality.failed for r in quality_rules.verdicts(docs).collect()} == {1: [], 2: [], 3: ["stop_words"], 4: [], 5: ["words", "repeated_windows"][1:] + ["mean_word_length", "stop_words"]}
    assert quality_rules.verdicts(docs.drop("lang")).filter("quality.kept").count() == 4


def test_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_quality_rules"](spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    assert not any(r.kept for r in rows if labels[r.doc_id] == 0)


def edf(weights, slots):
    """Earliest deadline first, slot by slot: (source, block, release, deadline)."""
    q, done, out = sum(weights), [0] * len(weights), []
    for t in range(slots):
        ready = [(-(-(done[i] + 1) * q // a), i) for i, a in enumerate(weights) if done[i] * q // a <= t]
        d, i = min(ready)
        out.append((i, done[i], done[i] * q // weights[i], d))
        done[i] += 1
    return out


def table(spark, given):
    return spark.createDataFrame(list(given), "source string, share double")


@pytest.mark.parametrize("shares,slots,frame", [([1.0], 20, 4), ([5.0, 3.0, 1.0, 1.0], 100, 16), ([7.0, 7.0, 7.0, 1.0, 2.0], 250, 30), ([0.61, 0.0001, 0.2, 0.1899], 900, 1), ([float(i % 9 + 1) for i in range(40)], 2000, 64)])
def test_timetable_is_edf_and_fair(spark, shares, slots, frame):
    names = [f"s{i:03}" for i in range(len(shares))]
    weights = mixing.units(table(spark, zip(names, shares, strict=True)))
    units = {r.source: r.a for r in weights.collect()}
    rows = sorted(mixing.timetable(weights, slots, frame).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(slots))
    assert [(names.index(r.source), r.block, r.release, r.deadline) for r in rows] == edf([units[s] for s in names], slots)
    ran, total = Counter(), sum(shares)
    for t, r in enumerate(rows, 1):
        assert r.release <= r.slot < r.deadline
        ran[r.source] += 1
        assert all(abs(ran[s] - t * w / total) < 1 for s, w in zip(names, shares, strict=True))


def test_timetable_of_irrational_weights_over_many_slots(spark):
    shares = {f"s{i}": math.sqrt(i + 2) ** 3 for i in range(12)}
    rows = sorted(mixing.timetable(mixing.units(table(spark, shares.items())), 6000, 500).collect(), key=lambda r: r.slot)
    ran, total = Counter(), sum(shares.values())
    for t, r in enumerate(rows, 1):
        ran[r.source] += 1
        assert all(abs(ran[s] - t * w / total) < 1 for s, w in shares.items())


def test_units_of_odd_shares(spark):
    given = [("a", 2.0), ("a", 1.0), ("b", 1.0), (None, 4.0), ("z", 0.0), ("n", None), ("m", -1.0), ("x", float("nan")), ("y", float("inf"))]
    assert {(r.source, r.a, r.q) for r in mixing.units(table(spark, given)).collect()} == {("a", 3, 8), ("b", 1, 8), (None, 4, 8)}
    assert mixing.units(table(spark, [])).count() == 0 and mixing.timetable(mixing.units(table(spark, [])), 10).count() == 0


def test_mix_equals_plain_python(spark):
    """Blocks, windows, slots and places of each row, from the rows' order within their source."""
    docs = [(i, "w" * (i * 37 % 50), "en", None if i % 11 == 0 else "abc"[i % 3 * (i % 2)], i) for i in range(300)] * 2
    docs += [(None, None, None, "z", None), (7, "long " * 5000, "en", "z", 1)]
    df = spark.createDataFrame(docs, DOCS)
    weights = {"a": 5.0, "b": 2.0, None: 1.0, "unknown": 9.0}
    rows = mixing.mix(df, table(spark, [*weights.items(), ("a", 1.0), ("c", 0.0)]), block_chars=500, frame=8).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter((d[0], d[1], d[3]) for d in docs)
    names = [None, "a", "b", "c", "z"]
    plan = {(names[i], j): (r, d, t) for t, (i, j, r, d) in enumerate(edf([1, 6, 2, 1, 1], 1000))}
    by_source = {}
    for r in rows:
        assert (r.mix_release, r.mix_deadline, r.mix_slot) == plan[r.source, r.mix_block]
        by_source.setdefault(r.source, []).append((r.mix_block, r.mix_place, len(r.text or "")))
    # Running sums: a row begins where those before it end.
    for own in by_source.values():
        at = 0
        for block, place, size in sorted(own):
            assert (block, place) == divmod(at, 500)
            at += size
    ordered = mixing.in_order(df, block_chars=500)
    assert ordered.columns == df.columns and ordered.count() == len(docs)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.in_order(df.limit(0)).count() == 0


def test_mix_given_weights_and_clashing_names(spark):
    df = spark.createDataFrame([(i, "x" * 100, "ab"[i % 2], "mine") for i in range(100)], "doc_id long, text string, source string, mix_slot string")
    out = mixing.mix(df, table(spark, [("a", 3.0), ("b", 1.0)]), block_chars=100)
    assert out.columns == ["doc_id", "text", "source", "mix_slot", "mix_block", "mix_release", "mix_deadline", "_mix_slot", "mix_place"]
    first = [r.source for r in out.collect() if r._mix_slot < 40]
    assert first.count("a") == 30 and first.count("b") == 10


def test_url_filter_asof(spark):
    events = spark.sql(
        "SELECT key, action, timestamp_ntz'2024-01-01' + make_dt_interval(d) AS at FROM VALUES ('bad.com','block',1),('bad.com',NULL,5),('ok.bad.com','allow',2),('x.org/p','block',0),(NULL,'block',0) AS t(key, action, d)"
    )
    day = lambda d: f"timestamp_ntz'2024-01-01' + make_dt_interval({d})"
    cases = [("http://Bad.com/a", 0, True), ("http://u@w.bad.com:80/", 1, False), ("http://bad.com", 4, False), ("http://bad.com", 5, True), ("http://ok.bad.com", 3, True), ("https://x.org/p/?q#f", 3, False), ("https://x.org/q", 3, True)]
    cases += [("nonsense", 3, True), ("", 3, True), ("http://bad.com", 4, False)]
    rows = " UNION ALL ".join(f"SELECT {i} AS i, '{u}' AS url, {day(d)} AS fetched_at, 'x' AS key" for i, (u, d, _) in enumerate(cases))
    judged = url_filters.judge(spark.sql(rows), events)
    assert {r.i: r.url_kept for r in judged.collect()} == {i: k for i, (_, _, k) in enumerate(cases)}
    nulls = spark.sql(f"SELECT CAST(NULL AS STRING) AS url, {day(3)} AS fetched_at UNION ALL SELECT 'http://bad.com', CAST(NULL AS TIMESTAMP_NTZ)")
    assert [r.url_kept for r in url_filters.judge(nulls, events).collect()] == [True, True]
    assert url_filters.judge(nulls.limit(0), events).count() == 0
    assert url_filters.judge(nulls, events.limit(0)).count() == 2


def test_url_filter_keeps_the_case_of_paths(spark):
    events = spark.sql("SELECT key, 'block' AS action, timestamp_ntz'2024-01-01' AS at FROM VALUES ('X.org/Spam/A'), ('BAD.com') AS t(key)")
    urls = {"http://x.ORG/Spam/A/": False, "http://x.org/spam/a": True, "http://x.org/Spam": True, "http://Bad.com/Q": False}
    captures = spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("url", "timestamp_ntz'2024-01-02' AS fetched_at")
    assert {r.url: r.url_kept for r in url_filters.judge(captures, events).collect()} == urls


def test_url_filter_normalises_keys(spark):
    events = spark.sql("SELECT key, 'block' AS action, timestamp_ntz'2024-01-01' AS at FROM VALUES ('Bad.com.'), ('x.org/Spam/'), (''), ('/'), ('zip') AS t(key)")
    urls = {"http://bad.com/a": False, "http://x.org/Spam": False, "http://x.org/": True, "http://any.zip/": False, "nothing": True, "http://": True}
    captures = spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("url", "timestamp_ntz'2024-01-02' AS fetched_at")
    assert {r.url: r.url_kept for r in url_filters.judge(captures, events).collect()} == urls


def test_url_filter_with_a_list_beyond_the_bound(spark, monkeypatch):
    """The same answers by broadcast and by dealing hot keys, against plain Python."""
    at = "timestamp_ntz'2024-01-01' + make_dt_interval(CAST({} AS INT))"
    events = spark.range(3000).selectExpr("concat('h', id % 700, IF(id % 3 = 0, '.com', '.org')) AS key", "IF(id % 5 = 0, NULL, IF(id % 7 = 0, 'allow', 'block')) AS action", at.format("id % 50") + " AS at")
    events = events.union(spark.sql(f"SELECT 'com', 'block', {at.format(40)}"))
    captures = spark.range(4000).selectExpr("id", "concat('http://', IF(id % 4 = 0, '', 'www.'), 'h', id * id % 900, IF(id % 2 = 0, '.com', '.org'), '/', id % 50) AS url", at.format("id % 60") + " AS fetched_at")
    judged = lambda: sorted(tuple(r) for r in url_filters.judge(captures, events).collect())
    whole = judged()
    monkeypatch.setattr(url_filters.shared, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(url_filters, "HOT_CAPTURES", 300)
    assert judged() == whole and len(whole) == 4000
    log = {}
    for r in events.collect():
        held = log.setdefault(r.key, {})
        held[r.at] = max(held.get(r.at, (False, "")), (r.action is None, r.action or ""))
    for r in captures.collect():
        host = r.url.split("/")[2]
        best = (0, "keep")
        for k in {host, host.removeprefix("www."), host.rsplit(".", 1)[1], host + "/" + r.url.rsplit("/", 1)[1]}:
            past = [t for t in log.get(k, {}) if t <= r.fetched_at]
            if past and not log[k][max(past)][0]:
                best = max(best, (len(k), log[k][max(past)][1]))
        assert whole[r.id][-2] == best[1], r


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def test_pii_equals_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    some = 0
    for r in QUERIES["op7_pii"](spark, sf).collect():
        want = spans(texts[r.doc_id])
        some += len(want)
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert r.n_spans == (len(r.spans.split(",")) if r.spans else 0) >= len(want)
        assert r.spans.startswith(joined(want))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in ("email", "ip", "card", "phone"))
    assert some > 20


def test_pii_edges(spark):
    texts = [None, "", "a@b.c+x@y.z@q.w", "a@b a@@b.c x@y..z x@y.z-", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.1.1 99999999999.1.1.1", "4111 1111-1111 1111 4111111111111112 4111-1111-1111-1111-", "+1 (017) 555-7713 +12 +123456789012345678 +1.2.3.4.5.6.7.8.9", "😀é a@b.c 😀 1.2.3.4", "1" * 50_000, "a" * 50_000 + "@", "a@" * 3000, "1 " * 20_000, "٣.٣.٣.٣ +٣٣٣ 333-444 555"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "y"), (None, texts[2], "z")], "doc_id long, text string, kind string")
    rows = pii.report(pii.detect(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.spans == joined(spans(texts[2 if r.doc_id is None else r.doc_id])), texts[r.doc_id]
    assert pii.detect(docs.limit(0)).count() == 0


def test_pii_disclosing_terms(spark):
    filler = [f"filler {'abcdefgh'[i % 8] * 3} text {'qrstuvwx'[i // 8 % 8] * 4}" for i in range(900)]
    told = [f"{f} write to Zebulon at z.b@mail.example soon {f}" for f in filler[:6]]
    others = [f"{f} write to somebody at p{i}@mail.example soon" for i, f in enumerate(filler[6:40])]
    alone = [f"{filler[3]} then ZEBULON spoke"]
    docs = spark.createDataFrame(list(enumerate(told + others + alone + filler[40:])), "doc_id long, text string")
    found, _ = pii.disclosing_terms(docs.selectExpr("doc_id AS _row", "text AS _text"), pii.Disclosure())
    assert [r.term for r in found.collect()] == ["zebulon"]
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert "z.b@" not in masked[0] and "Zebulon" not in masked[0] and "[TERM]" not in masked[0] and "[EMAIL]" in masked[0]
    assert "ZEBULON" not in masked[len(told) + len(others)]
    assert masked[len(told)] == others[0].replace("p0@mail.example", "[EMAIL]")
    # Exact copies are one context: they disclose nothing.
    copies = spark.createDataFrame([(i, told[0]) for i in range(50)] + list(enumerate(filler)), "doc_id long, text string")
    assert pii.disclosing_terms(copies.selectExpr("doc_id AS _row", "text AS _text"))[0].count() == 0


def told_terms(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, _text string")
    return {r.term: r for r in pii.disclosing_terms(docs)[0].collect()}


def test_pii_term_beside_several_kinds(spark):
    filler = [f"filler {'abcdefgh'[i % 8] * 3}{'ijklmnop'[i // 8 % 8] * 3}{'qrstuvwx'[i // 64] * 3} text" for i in range(500)]
    told = [f"{f} Zebulon z.b@mail.example +1 222 333 4444 1.2.3.4 {f}" for f in filler[:3]]
    found = told_terms(spark, told + filler)
    assert found["zebulon"].share == 1.0 and found["zebulon"].remove


def test_pii_copies_hide_no_term(spark):
    filler = [f"filler {'abcdefgh'[i % 8] * 3}{'ijklmnop'[i // 8 % 8] * 3}{'qrstuvwx'[i // 64] * 3} text" for i in range(500)]
    told = [f"{f} write to Zebulon at z.b@mail.example soon {f}" for f in filler[:6]]
    alone = [f"{filler[7]} then Zebulon spoke"]
    for copies, again in ((1, 1), (3, 1), (1, 100)):
        found = told_terms(spark, told * copies + alone * again + filler)
        assert round(found["zebulon"].share, 3) == round(6 / 7, 3), (copies, again)


def test_pii_mutual_information_counts_the_entity(spark):
    filler = [f"filler {'abcdefgh'[i % 8] * 3}{'ijklmnop'[i // 8 % 8] * 3}{'qrstuvwx'[i // 64] * 3} text" for i in range(500)]
    footer = [f"{f} help@site.example" for f in filler[:250]]
    chance = [f"{f} zymurgy help@site.example" for f in filler[250:253]]
    told = [f"{f} Zebulon z.b@mail.example" for f in filler[253:256]]
    found = told_terms(spark, footer + chance + told + filler[256:])
    assert "zymurgy" not in found
    assert round(found["zebulon"].bits, 3) == round(math.log2(len(footer + chance + told + filler[256:]) / 3), 3)


def test_pii_many_matches_in_one_text(spark):
    """Time must not grow with the square of the matches: 32,000 in one text took minutes when arrays grew match by match."""
    text = " ".join(f"Näme{i % 7} 😀 u{i}@mail{i % 500}.example" for i in range(32_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.monotonic()
    row = pii.report(pii.detect(docs)).first()
    assert row.n_email == 32_000 and row.base_sha256 == hashlib.sha256(joined(spans(text)).encode()).hexdigest()
    assert pii.mask(docs).first().text == re.sub(r"u\d+@\S+", "[EMAIL]", text)
    assert time.monotonic() - started < 60


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_running_folds(spark, n):
    values = [(i * 7919) % 23 - 5 for i in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(pii._running(F.col("v"), lambda a, x: a + x, F.lit(0)).alias("s"), pii._running(F.col("v"), lambda a, x: F.greatest(a, x), F.lit(0)).alias("m")).first()
    assert row.s == [sum(values[:i]) for i in range(n + 1)] and row.m == [max([0, *values[:i]]) for i in range(n + 1)]


def test_pii_mask_overlaps(spark):
    docs = spark.createDataFrame([(1, "call +1.222.333.4444 or 1.2.3.4 now", "k"), (2, None, "k")], "doc_id long, text string, pii string")
    rows = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert rows[1].text == "call +[IP][PHONE] or [IP] now" or rows[1].text == "call [PHONE] or [IP] now"
    assert rows[2].text is None and rows[1].pii == "k"


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c " * 60, "s", "old", 2, 3, 4, 5)], "doc_id long, text string, source string, quality string, pii int, _bucket int, _host int, url_host int")
    assert quality_rules.verdicts(docs).columns[-1] == "_quality" and quality_rules.verdicts(docs).first().quality == "old"
    found = pii.detect(docs)
    assert found.columns == [*docs.columns, "_pii"] and pii.report(found).first().n_email == 60
    assert mixing.mix(docs).first()._bucket == 3
    events = spark.sql("SELECT 'b.c' AS key, 'block' AS action, timestamp_ntz'2024-01-01' AS at")
    judged = url_filters.judge(docs.selectExpr("'http://b.c/x' AS url", "timestamp_ntz'2024-02-01' AS fetched_at", "_host", "url_host"), events)
    row = judged.first()
    assert judged.columns[4] == "_url_host" and (row._host, row.url_host, row._url_host, row.url_kept) == (4, 5, "b.c", False)
