"""Each operator against a brute-force version on small frames with nulls, empty and repeated rows, ties and odd columns."""

import base64
import collections
import datetime
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, mtree, pieces, pseudonyms, quality, repeats, rollups, toxicity, warc
from tidemark.llm.components import components
from tidemark.llm.words import Chunk, by_key, chunks, hash_bytes, NOT_ALNUM

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators might use themselves.
CLASH = {"row": "1", "key": "'k'", "words": "2.0D", "n": "3", "score": "cast(null as double)", "label": "9", "a": "0"}


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.expr(x) for c, x in CLASH.items()})


def prose(r, n, vocabulary=40):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3):
    """Texts with copies, near copies, shared passages, a common line and edge cases."""
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 90), 3000) for _ in range(60)]
    passage, line = prose(r, 45, 3000), prose(r, 21, 3000)
    for i in range(0, 40, 3):
        texts[i] += " " + passage + "\n" + prose(r, 5)
    texts += [line + "\t" + x for x in texts[:20]]
    for _ in range(30):
        words = texts[5].split() + prose(r, 60, 7).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = f"n{r.randrange(99)}"
        texts.append(" ".join(words))
    texts += [texts[7]] * 9 + ["", None, None, " \n", "one", "One", "two words", "A b c", "a B c", "x " * 70, " x y é漢"]
    return texts


# --- helpers


def test_words_and_hashes():
    c = next(chunks(pa.array(["x idiot, y", None, "", "Idiot\n"])))
    s, e, at = c.lowered().words(NOT_ALNUM)
    h = c.lowered().word_hashes(s, e)
    assert at.tolist() == [0, 3, 3, 3, 4] and h[1] == h[3] == hash_bytes("idiot")
    assert Chunk(np.zeros(0, np.uint8), np.zeros(2, np.int64)).words()[2].tolist() == [0, 0]


@pytest.mark.parametrize("small", [0, 20, 100_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr("tidemark.llm.components.SMALL", small)
    r = random.Random(5)
    for links in ([], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(r.randrange(80), r.randrange(80)) for _ in range(60)]):
        roots = {x: x for p in links for x in p}
        for _ in roots:
            for a, b in links:
                roots[a] = roots[b] = min(roots[a], roots[b])
        found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert {x: found.get(x, x) for x in roots} == roots
        half = len(links) // 2
        frame = lambda x: spark.createDataFrame(x, "a long, b long")
        rows = components(frame(links[half:]), components(frame(links[:half]))).collect()
        assert len(rows) == len({r.node for r in rows}) and {x: {r.node: r.root for r in rows}.get(x, x) for x in roots} == roots


# --- 1


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def with_check(payload):
    return next(payload + c for c in "0123456789" if luhn(payload + c))


def test_pseudonyms(spark):
    r = random.Random(2)
    cards = [with_check("".join(r.choice("0123456789") for _ in range(n - 1))) for n in range(13, 20)]
    spaced = f"{cards[3][:4]} {cards[3][4:8]}-{cards[3][8:12]} {cards[3][12:]}"
    bad = cards[3][:-1] + str((int(cards[3][-1]) + 1) % 10)
    texts = [" ".join(cards), spaced, bad, "Am@b.example.com. an.12@c.org!", "+1 (017) 555-7713%%%", "7.88.85.226 and 300.1.1.1", "1987-02-28, 28/02/1987 and 28.02.1987", "1987-02-30 123-45-6789 000-45-6789", None, "", "no digits", "9" * 40]
    df = docs_of(spark, texts)
    found = pseudonyms.pseudonymise(df, counts="replaced", n_chars="n_chars").orderBy("doc_id").collect()
    out = [x.text for x in found]
    new = out[0].split()
    assert [len(x) for x in new] == [len(x) for x in cards] and all(map(luhn, new)) and not set(new) & set(cards)
    assert re.sub("[ -]", "", out[1]) == new[3] and re.sub("[0-9]", "9", out[1]) == re.sub("[0-9]", "9", spaced)
    assert out[2] == bad and out[8] is None and out[9] == "" and out[10] == texts[10] and out[11] == texts[11]
    assert re.fullmatch(r"[a-z]{2}@b\.example\.com\. [a-z]{2}\.[0-9]{2}@c\.org!", out[3]) and out[3] != texts[3].lower()
    assert re.fullmatch(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}%%%", out[4]) and out[4] != texts[4]
    assert out[5].endswith("300.1.1.1") and not out[5].startswith("7.88.85.226")
    a, b, _, c = out[6].replace(",", "").split()
    assert a == "-".join(reversed(b.split("/"))) == "-".join(reversed(c.split("."))) != "1987-02-28"
    assert out[7].startswith("1987-02-30 ") and out[7].endswith("000-45-6789") and "123-45-6789" not in out[7]
    assert found[0].replaced == {"card": 7} and [x.n_chars for x in found if x.text] == [len(x.text) for x in found if x.text]
    assert found[0].asDict().keys() - {"replaced"} == set(df.columns)
    other = pseudonyms.pseudonymise(df, key="other").orderBy("doc_id").first().text
    assert other not in (out[0], texts[0])
    assert pseudonyms.pseudonymise(docs_of(spark, [])).count() == 0


def test_pseudonyms_of_neighbours(spark):
    """Every value is masked as it is alone, whatever follows or precedes it after a blank."""
    card, amex = with_check("411122223333444"), with_check("37828224631000")
    printed = [card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f"{amex[:4]}-{amex[4:10]}-{amex[10:]}"]
    values = ["+1 (826) 555-4081", "+1 826 555 7672", "+49 30 1234567", "190.137.223.204", "28.02.1987", "2024-05-06", "826-555-4081", "(826) 555-4081", "123-45-6789", "123@c.org", *printed]
    pairs = [(x, y) for x in values for y in values]
    loose = [("+1 (017) 555-7713", "2024"), ("+7 826 555-40-81", "12"), (printed[1], "124"), ("2024", printed[1]), ("192", printed[0]), ("2024 31", printed[1])]
    odd = f"{card[:3]} {card[3:6]} {card[6:9]} {card[9:12]} {card[12:]}"
    texts = values + [f"{x} {y}" for x, y in pairs + loose + [(y, x) for x, y in loose[2:]]] + [odd, odd + " 12", odd + " 2024"]
    found = pseudonyms.pseudonymise(docs_of(spark, texts), counts="replaced").orderBy("doc_id").collect()
    new = {x: r.text for x, r in zip(values, found)}
    assert all(x != y for x, y in new.items())
    for text, row in list(zip(texts, found))[len(values) :][: len(pairs)]:
        x, y = pairs[texts.index(text, len(values)) - len(values)]
        assert row.text == f"{new[x]} {new[y]}" and sum(row.replaced.values()) == 2, text
    rest = found[len(values) + len(pairs) :]
    assert rest[0].text.endswith(" 2024") and rest[1].text.endswith(" 12") and rest[2].text == new[printed[1]] + " 124"
    assert [r.text for r in rest[3:6]] == ["2024 " + new[printed[1]], "192 " + new[printed[0]], "2024 31 " + new[printed[1]]]
    assert rest[-2].text == rest[-3].text + " 12" and rest[-1].text == rest[-3].text + " 2024" and rest[-3].text != odd


def feistel(kind, left, right, a, b, tweak=""):
    """The network in plain Python."""
    draw = lambda *parts: int(hashlib.sha256("|".join(map(str, ("k", kind, tweak, *parts))).encode()).hexdigest()[:15], 16)
    for i in range(pseudonyms.ROUNDS):
        left = (left + draw("l", i, right) % a) % a
        right = (right + draw("r", i, left) % b) % b
    return left, right


def digits_by_hand(kind, d):
    half = len(d) // 2
    a, b = feistel(kind, int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), len(d))
    return f"{a:0{half}d}{b:0{len(d) - half}d}"


def pseudonym_by_hand(kind, x):
    if kind == "date":
        first = datetime.date(1900, 1, 1)
        a, b = feistel("date", *divmod((datetime.date.fromisoformat(x) - first).days, 4297), 17, 4297)
        return (first + datetime.timedelta(a * 4297 + b)).isoformat()
    if kind == "ssn":
        areas = [f"{i:03d}" for i in range(1, 900) if i != 666]
        area, group, serial = x.split("-")
        a, b = feistel("ssn", areas.index(area) * 99 + int(group) - 1, int(serial) - 1, 898 * 99, 9999)
        return f"{areas[a // 99]}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "ip":
        o = list(map(int, x.split(".")))
        a, b = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "card":
        payload = digits_by_hand("card", x[:-1])
        return next(y for y in (payload + c for c in "0123456789") if luhn(y))
    return x[:2] + digits_by_hand("phone", x[2:])


def test_pseudonyms_by_hand(spark):
    r = random.Random(9)
    some = {
        "date": [(datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(73049))).isoformat() for _ in range(40)] + ["1900-01-01", "2099-12-31"],
        "ssn": [f"{r.choice([1, 665, 667, 899, r.randint(1, 665)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" for _ in range(60)],
        "ip": [".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(30)],
        "card": [with_check("".join(r.choice("0123456789") for _ in range(r.randint(12, 18)))) for _ in range(30)],
        "phone": [f"+1{r.randrange(10**10):010d}" for _ in range(20)] + [f"+7{r.randrange(10**10):010d}" for _ in range(20)],
    }
    values = [(k, x) for k, xs in some.items() for x in xs]
    found = pseudonyms.pseudonymise(docs_of(spark, [x for _, x in values]), key="k").orderBy("doc_id").collect()
    for (kind, x), row in zip(values, found):
        assert row.text == pseudonym_by_hand(kind, x), (kind, x)
        if kind == "ssn":
            assert not re.search("^(?:000|666|9)|-00-|0000$", row.text)
        if kind == "date":
            assert "1900-01-01" <= row.text <= "2099-12-31"


def test_phones_are_linked_however_they_are_written(spark):
    texts = ["+1-555-123-4567", "+15551234567", "+1 (555) 123-4567", "555-123-4567", "(555) 123-4567", "+44 20 7946 0958", "+442079460958", "+353 1 234 5678", "+35312345678", "+33 1 23 45 67 89", "+33123456789"]
    out = [re.sub("[^0-9]", "", x.text) for x in pseudonyms.pseudonymise(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert {x.removeprefix("1") if len(x) == 11 else x for x in out[:5]} == {out[3]} and out[0][0] == "1" and out[3] != "5551234567"
    assert out[5] == out[6] != "442079460958" and out[5].startswith("44") and out[7] == out[8] != "35312345678" and out[7].startswith("353") and out[9] == out[10] != "33123456789"


def test_the_key_comes_from_the_session(spark):
    docs = docs_of(spark, ["123-45-6789"] * 2)
    known = {x.text for x in pseudonyms.pseudonymise(docs).collect()}
    spark.conf.set(pseudonyms.KEY_CONF, "of the session")
    try:
        own = {x.text for x in pseudonyms.pseudonymise(docs).collect()}
    finally:
        spark.conf.unset(pseudonyms.KEY_CONF)
    assert len(known) == len(own) == 1 and known != own == {x.text for x in pseudonyms.pseudonymise(docs, key="of the session").collect()}


def test_feistel_is_a_permutation(spark):
    days = spark.range(17 * 4297).select(pseudonyms.feistel("k", "d", F.floor(F.col("id") / 4297), F.col("id") % 4297, 17, 4297).alias("p"))
    assert days.distinct().count() == 17 * 4297 == 73049
    digits = spark.range(1000).select(pseudonyms.permuted_digits("k", "d", F.lpad(F.col("id").cast("string"), 3, "0")).alias("p"))
    assert {x.p for x in digits.collect()} == {f"{i:03d}" for i in range(1000)}


def test_pseudonyms_are_native(spark):
    plan = pseudonyms.pseudonymise(docs_of(spark, ["1.2.3.4"]), counts="c")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 2


def brute_repeats(rows, window=20):
    first = {}
    for i, t in rows:
        w = (t or "").encode()
        w = w.split()
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, (i, k)), (i, k))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (i, k) for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("heavy,batch", [(256, 20_000), (2, 20_000), (3, 50)])
def test_repeats(spark, monkeypatch, heavy, batch):
    monkeypatch.setattr(repeats, "BATCH_ROWS", batch)
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    df = docs_of(spark, texts, ids).repartition(5)
    found = repeats.without_repeats(df, heavy=heavy)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == brute_repeats(list(zip(ids, texts)))
    assert all((r.kept is None) == (t is None) for (r, t) in zip(found.orderBy("doc_id").collect(), [t for _, t in sorted(zip(ids, texts), key=lambda x: x[0])]))


def test_texts_are_dealt_out_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = repeats.without_repeats(docs_of(spark, corpus()))
        found.collect()
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeats_edge_cases(spark):
    t = " ".join(f"v{i}" for i in range(25))
    df = docs_of(spark, [t, t, t, t + " x", None], [5, 5, None, 5, None])
    found = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in repeats.without_repeats(df).collect())
    # equal rows are one document; another text of the same id starts at the same words, so not earlier; null ids stay out
    assert found == sorted([("5", 25, 0), ("5", 25, 0), ("None", 25, 0), ("5", 26, 0), ("None", 0, 0)])
    assert repeats.without_repeats(docs_of(spark, [])).count() == 0
    assert sorted(r.n_removed for r in repeats.without_repeats(docs_of(spark, ["a " * 30, "b " * 19])).collect()) == [0, 29]


# --- 3


def brute_topk(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.setdefault(i, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for q, vs in usable.items():
        if q % 50 == 0:
            for v in vs:
                scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, ws in usable.items() if i != q for w in ws if len(w) == len(v))
                out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("page,shard", [(256, 1 << 14), (4, 90)])
def test_mtree(spark, monkeypatch, page, shard):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "SHARD", shard)
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (5, 8))
    vectors = [(centres[r.integers(5)] + r.normal(0, 0.3, 8)).astype(np.float32).tolist() for _ in range(300)]
    vectors[50:90] = [vectors[50]] * 40
    vectors[100], vectors[101], vectors[102], vectors[103], vectors[150] = None, [], [float("nan")] * 8, [None] + [0.0] * 7, [1.0, 2.0]
    rows = list(zip(range(300), vectors)) + [(None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"shard": F.lit(0), "id": F.lit("x")}).repartition(3)
    found = mtree.search(mtree.build(df), df.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, found.collect())) == brute_topk(rows, 5)
    assert mtree.search(mtree.build(df.limit(0)), df, 5).count() == 0 and mtree.search(mtree.build(df), df.limit(0), 5).count() == 0


def test_mtree_of_large_components(spark):
    """Components that 32 bits do not hold, and scores that floating-point numbers do not."""
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) * 10 ** r.choice([0, 3, 7]) for _ in range(6)]) for i in range(120)] + [(200 + i, [4e6 + i / 256, 3e6, 2e6]) for i in range(9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mtree.search(mtree.build(vectors), vectors.where("vec_id % 50 = 0"), 5).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for q in [i for i in whole if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert [(x.vec_id, x.score) for x in sorted(found, key=lambda x: x.rank) if x.query_id == q] == [(i, -s) for s, i in scores]
    with pytest.raises(Exception, match="64 bits"):
        mtree.build(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_mtree_blocks(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK", 2)
    rows = [(i * 50, [float(i), 1.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, mtree.search(mtree.build(df), df, 3).collect())) == brute_topk(rows, 3)


# --- 4, 5


def labelled(spark, n=600, seed=8):
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.3
        words = prose(r, r.randint(5, 60), 200).split()
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words.insert(r.randrange(len(words)), "awful")
        rows.append(" ".join(words))
        marks.append((i, int(good), int(toxic)))
    rows += ["", None]
    labels = spark.createDataFrame([*marks, marks[0], (None, 1, 1), (n, None, None)], "doc_id long, quality int, toxic int")
    return docs_of(spark, rows), labels, marks


def test_quality(spark):
    docs, labels, marks = labelled(spark)
    model = quality.train(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[i] >= quality.THRESHOLD) == bool(q) for i, q, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.97
    assert scores == {r.doc_id: r.score for r in quality.score(docs.repartition(7), quality.train(docs.repartition(3), labels)).collect()}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    blank = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}


def test_factorisation_identity():
    r = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.3, r.normal(size=quality.FEATURES).astype(np.float32), r.normal(size=(quality.FEATURES, quality.RANK)).astype(np.float32))
    i, x = np.array([3, 9, 70]), np.array([0.5, 2.0, 1.0], np.float32)
    pairs = sum(float(m.factors[i[a]] @ m.factors[i[b]]) * x[a] * x[b] for a, b in itertools.combinations(range(3), 2))
    assert np.isclose(m.raw(i, x, np.array([0, 3]))[0][0], 0.3 + float(m.weight[i] @ x) + pairs, atol=1e-4)


def test_toxicity(spark):
    docs, labels, marks = labelled(spark)
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.97
    assert scores == {r.doc_id: r.score for r in toxicity.score(docs.repartition(6), model).collect()}
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).count() == docs.count()


def shared_of(spark, texts, words):
    return toxicity.shared_counts(docs_of(spark, texts).repartition(3), np.sort(np.array([hash_bytes(w) for w in words], np.uint64)))


def test_shared_counts_cover_all_texts(spark):
    shared = shared_of(spark, ["a b", "c b", "d b", "a e", None], ["b", "e"])
    at = lambda w: shared[hash_bytes(w)]
    assert np.isclose(shared.p.sum() + shared.other, 1) and at("b") > 2 * at("e") and at("unseen") == at("a") == shared.other
    assert np.allclose(shared_of(spark, [None, ""], ["b", "e"]).p, 1 / 3) and shared_of(spark, ["a b"], []).other == 1


@pytest.mark.parametrize("pairs,held", [(100, 150), (1 << 21, 1 << 22)])
def test_shared_counts_are_exact(spark, monkeypatch, pairs, held):
    monkeypatch.setattr(toxicity, "PAIRS", pairs)
    monkeypatch.setattr(toxicity, "HELD", held)
    r = random.Random(6)
    texts = [f"p{i} hot" for i in range(1000)] * 2 + [prose(r, r.randint(1, 60)) for _ in range(300)] + ["", None, "alone"]
    known = {"hot", "p3", "alone", "never", *(f"w{i}" for i in range(0, 40, 2))}
    shared = shared_of(spark, texts, known)
    before = collections.defaultdict(set)
    for own in (alnum(t) for t in texts):
        for a, b in zip(own, own[1:]):
            before[b if b in known else None].add(a if b in known else (a, b))
    total = sum(map(len, before.values())) + (len(known) + 1) / 2
    for w in (*known, "w1", "p4", "unseen"):
        assert np.isclose(shared[hash_bytes(w)], (len(before.get(w if w in known else None, ())) + 0.5) / total)


def test_kneser_ney_by_hand(spark):
    """The ratios of the whole sample against counts and formulas on plain dictionaries."""
    docs, labels, marks = labelled(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    sample = [(alnum(texts[i]), t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 3 != 1 and i in texts]
    n = [collections.Counter(w for own, t in sample if t == c for w in set(own)) for c in (0, 1)]
    total = [max(1, sum(x.values())) for x in n]
    known = {w for w in n[0] | n[1] if n[0][w] + n[1][w] >= toxicity.CUTOFF}
    before = collections.defaultdict(set)
    for t in texts.values():
        own = alnum(t)
        for a, b in zip(own, own[1:]):
            before[b if b in known else None].add(a if b in known else (a, b))
    pairs = sum(map(len, before.values())) + (len(known) + 1) / 2
    pooled = {w: max(n[0][w] + n[1][w] - toxicity.DISCOUNT[0], 0) / sum(total) for w in known}
    less = [{w: max(n[c][w] - max(toxicity.DISCOUNT[1 + c], toxicity.BURST[c] * sum(t == c for _, t in sample)), 0) / total[c] for w in known} for c in (0, 1)]
    rest = [max(1e-6, 1 - sum(x.values())) for x in less]
    shared = {w: pooled[w] + (len(before[w]) + 0.5) / pairs * (1 - sum(pooled.values())) for w in known}
    model = toxicity.train(docs, labels).model
    assert len(model.words) == len(known)
    ratio = lambda w: math.log((less[1][w] + rest[1] * shared[w]) / (less[0][w] + rest[0] * shared[w])) if w in known else math.log(rest[1] / rest[0])
    words = [*known, "never seen"]
    assert np.allclose(model.ratios(np.array([hash_bytes(w) for w in words], np.uint64)), [ratio(w) for w in words])


# --- 6


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_contamination(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, ids = alnum(t), set(), set()
        for item, x in items:
            v = alnum(x)
            n = min(window, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_long_words_and_texts(spark):
    """A word of 1 MB costs its bytes, not those of all suffixes; nor do long texts."""
    long = "q" * 1_000_000
    r = random.Random(7)
    text = prose(r, 60_000, 500)
    items = [(str(i), prose(r, 12, 500)) for i in range(60)] + [("long", long), ("in", "a b c d " + long + " e f g h i j k"), ("not", "a b c d " + long + "q e f g h i j k")]
    docs = [text + " " + items[3][1], f"x a b c d {long} e f g h i j k y", "w " * 20 + long, "z" * 2_000_000, long[:-1]]
    began = time.process_time()
    tests = decontaminate.TestSuffixes([i for i, _ in items], [t for _, t in items], 10)
    assert tests._eight.nbytes < 40_000_000
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = {x.doc_id: x for x in decontaminate.matches(docs_of(spark, docs), benchmark).collect()}
    assert [sorted(found[i]["items"]) for i in range(5)] == [["3"], ["in", "long"], ["long"], [], []]
    assert found[1].spans[0].asDict() == {"first": 1, "n": 12} and time.process_time() - began < 60
    kept = {x.doc_id: x for x in repeats.without_repeats(docs_of(spark, [docs[0], docs[0] + " " + long, docs[3]])).collect()}
    assert kept[0].n_removed == 0 and kept[1].n_removed == kept[1].n_words - 1 and kept[2].n_words == 1


@pytest.mark.parametrize("block,shard", [(1 << 24, 1 << 22), (40, 300)])
def test_contamination(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    r = random.Random(6)
    items = [(k, prose(r, r.choice([3, 9, 10, 14, 25]), 300)) for k in range(12)]
    items += [(20, items[0][1]), (3, items[3][1]), (21, ""), (22, None), (23, "É漢, Ça!"), (24, "w1")]
    texts = corpus(7)[:60]
    for k in range(0, 40, 2):
        words = texts[k].split()
        a = items[k % 12][1].split()
        words[2:2] = a[r.randrange(3) :][: r.randint(5, 25)]
        texts[k] = ", ".join(words).upper() if k % 4 else "\n".join(words)
    texts += ["x é漢 ça y", "w1", "w11", None, ""]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    found = decontaminate.matches(docs, bench)
    rows = decontaminate.report(found).drop("longest").collect()
    expected = brute_contamination(list(enumerate(texts)), items)
    assert sorted(map(tuple, rows)) == expected
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [x[0] for x in expected if not x[5]]
    for r_ in found.collect():
        w = alnum(texts[r_.doc_id])
        assert all(0 <= s.first and s.first + s.n <= len(w) for s in r_.spans)
    assert decontaminate.report(decontaminate.matches(docs, bench.limit(0))).where("contaminated").count() == 0
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


# --- 7


def brute_clusters(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return sorted((i, len(sets[i]), root[i]) for i in sets)


@pytest.mark.parametrize("k,percent,short,group,batch", [(4, 85, 24, 128, 100_000), (4, 85, 3, 4, 60), (5, 80, 2, 2, 10), (2, 50, 3, 128, 100_000)])
def test_clusters(spark, monkeypatch, k, percent, short, group, batch):
    for name, x in (("SHORT", short), ("GROUP", group), ("BATCH_ROWS", batch)):
        monkeypatch.setattr(jaccard, name, x)
    texts = corpus(9)
    ids = list(range(len(texts)))
    random.Random(4).shuffle(ids)
    docs = docs_of(spark, texts, ids).repartition(5)
    found = jaccard.clusters(docs, shingle=k, percent=percent)
    expected = brute_clusters(list(zip(ids, texts)), k, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == expected
    if short == 24:
        kept = jaccard.keep_one(docs, shingle=k, percent=percent)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _, c in expected if i == c]


@pytest.mark.parametrize("block", [3, 20])
def test_a_large_list_of_many_roots(spark, monkeypatch, block):
    """No comparison has more than two blocks' members, a root's own members are not compared, and no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(12)
    passage = prose(r, 40, 3000)
    texts = [passage + " " + prose(r, r.randint(8, 60), 3000) for _ in range(60)]
    texts += [" ".join([*x.split()[:-1], f"z{i}"]) for i, x in enumerate(texts[:30])] + [texts[0] + f" y{i}" for i in range(40)]
    ids = list(range(len(texts)))
    random.Random(4).shuffle(ids)
    found = jaccard.clusters(docs_of(spark, texts, ids).repartition(3))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found.collect()) == brute_clusters(list(zip(ids, texts)))
    many = [(i, i, 100 + i % 7, i if i < 50 else 0) for i in range(200)]
    members = spark.createDataFrame([(t, s1, n, root) for s1, _, n, root in many for t in (1, 2) if t == 1 or root == 0], "token long, s1 long, n long, root long")
    rows, pairs = (x.collect() for x in jaccard._blocks(jaccard._several(members), 85))
    blocks = collections.defaultdict(list)
    for x in rows:
        blocks[x.token, x.block].append((x.s1, x.root))
    seen = {frozenset((a, b)) for p in pairs for a, i in blocks[p.token, p.x] for b, j in blocks[p.token, p.y] if i != j}
    assert {x.token for x in rows} == {1} and max(map(len, blocks.values())) < 4 * block + 12
    assert seen == {frozenset((a, b)) for a, _, _, i in many for b, _, _, j in many if i != j}
    assert all(len({i for _, i in blocks[p.token, p.x] + blocks[p.token, p.y]}) > 1 for p in pairs)


def near_copies(r, m, words, edits):
    base = [f"b{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(m):
        own = list(base)
        for i in r.sample(range(words), edits):
            own[i] = f"e{r.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("nearest", [1, 16])
def test_near_copies_about_the_threshold(spark, monkeypatch, nearest):
    """Groups whose pairs lie just below and above the similarity: no link is lost, and far fewer pairs than a group has are looked
    at one by one (whole blocks are searched where more than ``NEAREST`` are possible)."""
    seen, searched = [], []
    verify, search = jaccard._verified, jaccard._searched
    monkeypatch.setattr(jaccard, "NEAREST", nearest)
    monkeypatch.setattr(jaccard, "LONG", 30)
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *x: seen.append(pairs.count()) or verify(pairs, *x))
    monkeypatch.setattr(jaccard, "_searched", lambda *x: searched.append(1) or search(*x))
    r = random.Random(5)
    texts = near_copies(r, 60, 120, 2) + near_copies(r, 150, 500, 6) + near_copies(r, 40, 500, 7) + near_copies(r, 40, 300, 1)
    found = jaccard.clusters(docs_of(spark, texts), shingle=5, percent=80)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found.collect()) == brute_clusters(list(enumerate(texts)), 5, 80)
    assert sum(seen) < 12 * len(texts) and (searched or nearest > 1)


def test_spanning_links():
    r = np.random.default_rng(8)
    for _ in range(40):
        base = np.arange(40)
        sets = [np.unique(np.concatenate([r.choice(base, 34, replace=False), r.integers(100, 140, 2)])).astype(np.uint64) for _ in range(r.integers(2, 30))]
        root, side = r.integers(0, 12, len(sets)), np.sort(r.integers(0, 2, len(sets)) * r.integers(0, 2))
        linked = lambda i, j: 100 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 70 * len(set(sets[i].tolist()) | set(sets[j].tolist()))
        both = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if linked(i, j) and (side[i] != side[j] or side[0] == side[-1])]
        found = list(jaccard.spanning_links(sets, root, side, 70))

        def joined(links):
            group = root.copy()
            for _ in sets:
                for i, j in links:
                    group[(group == group[i]) | (group == group[j])] = min(group[i], group[j])
            return group.tolist()

        assert all(linked(i, j) for i, j in found) and joined(found) == joined(both) and len(found) < len(set(root.tolist()))


@pytest.mark.parametrize("part,copies", [(4096, 3000), (2, 9)])
def test_parts_of_a_list_meet_however_short(spark, monkeypatch, part, copies):
    """Lists that are cut because of copies, and have few different sets: seven and six shingles, six of them shared."""
    monkeypatch.setattr(jaccard, "PART", part)
    texts = []
    for g in range(8):
        short = " ".join(f"w{g}x{i}" for i in range(9))
        texts += [short, f"{short} w{g}x9"] * copies
    found = jaccard.clusters(docs_of(spark, texts)).groupBy("component_id").count().collect()
    assert sorted(map(tuple, found)) == [(2 * copies * g, 2 * copies) for g in range(8)]


def test_texts_of_equal_structure_are_told_apart(spark):
    """Two words that hashes by powers modulo 2^64 cannot tell apart."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    assert hash_bytes(morse) != hash_bytes(other) and hash_bytes(morse[:256]) != hash_bytes(other[:256])
    tail = " ".join(f"v{i}" for i in range(3))
    texts = [f"{morse[:256]} {tail}", f"{other[:256]} {tail}", morse, other, other]
    assert [x.component_id for x in jaccard.clusters(docs_of(spark, texts)).orderBy("doc_id").collect()] == [0, 1, 2, 3, 3]


def test_batches_are_cut_between_keys():
    keys = np.repeat([1, 2, 3, 4, 5], [3, 900, 1, 40, 2])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7])], names=["k"]) for i in range(0, len(keys), 7)]
    for most in (1, 10, 100, 10_000):
        out = [x.column("k").to_pylist() for x in by_key(iter(batches), ["k"], most)]
        assert sum(out, []) == keys.tolist() and all(a[-1] != b[0] for a, b in zip(out, out[1:]))
    assert list(by_key(iter([]), ["k"], 9)) == []


def test_clusters_edge_cases(spark):
    t = " ".join(f"v{i}" for i in range(30))
    docs = docs_of(spark, [t, t, t, "other", None], [7, 7, None, 7, None])
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.clusters(docs).collect())
    assert found == sorted([("7", 27, "7"), ("7", 27, "7"), ("None", 27, "None"), ("7", 1, "7"), ("None", 0, "None")])
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs).collect()) == ["7", "None", "None"]
    assert jaccard.clusters(docs_of(spark, [])).count() == 0


def test_an_id_links_its_texts(spark):
    """Copies of both texts of id 5 under other ids are one component, as are its rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = docs_of(spark, [a, a, b, "", b, c, c], [1, 5, 5, 5, 9, 6, 7])
    assert sorted((x.doc_id, x.component_id) for x in jaccard.clusters(docs).collect()) == [(1, 1), (5, 1), (5, 1), (5, 1), (6, 6), (7, 6), (9, 1)]


def test_only_repeated_ids_are_sorted(spark):
    docs = docs_of(spark, ["a b", "c d", "e f", "g h", "i j"], [7, 7, None, None, 8])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(x.doc_id), x.text) for x in kept.collect()) == [("7", "a b"), ("8", "i j"), ("None", "e f"), ("None", "g h")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Union" in plan and "LeftSemi" in plan[plan.index("Window [") :]


def test_divide_skip():
    r = np.random.default_rng(3)
    for _ in range(60):
        query = np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.uint64)
        sets = []
        for _ in range(r.integers(1, 9)):
            own = set(query.tolist())
            for x in r.integers(0, 60, r.integers(0, 8)).tolist():
                own ^= {x}
            sets.append(np.array(sorted(own or {99}), np.uint64))
        sizes = np.array([len(x) for x in sets])
        found = jaccard.divide_skip(query, np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes, 70)
        both = [len(set(query.tolist()) & set(x.tolist())) for x in sets]
        assert found.tolist() == [i for i, b in enumerate(both) if 100 * b >= 70 * (len(query) + len(sets[i]) - b)]


# --- 8


def test_pieces(spark):
    texts = ["the cat  sat\n on▁ it ▁", " lead", "", None, "é漢字🎉\x00 tab\t  ", "a" * 300, "The quick brown fox. " * 20, "▁▁ ▁", " "]
    docs = docs_of(spark, texts)
    coded = pieces.encode(docs, also=("lang", "key"))
    assert coded.columns == ["doc_id", "lang", "key", "piece_ids"]
    back = {r.doc_id: r.text for r in pieces.decode(coded).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    ids = {r.doc_id: r.piece_ids for r in coded.collect()}
    assert ids == {r.doc_id: r.piece_ids for r in pieces.encode(docs.repartition(4)).collect()}
    assert ids != {r.doc_id: r.piece_ids for r in pieces.encode(docs, seed=21).collect()}
    trip = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    for i, t in enumerate(texts):
        assert trip[i].lossless is (None if t is None else True) and trip[i].n_pieces == (None if t is None else len(ids[i]))
    assert pieces.encode(docs.limit(0)).count() == 0


def test_pieces_have_the_lattice_distribution():
    v = pieces.Pieces(pieces.TOKENIZER, alpha=0.3)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.TOKENIZER)
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def segmentations(w):
        if not w:
            yield (), 0.0
        for k in range(1, len(w) + 1):
            if (i := known.get(w[:k])) is not None:
                for rest, x in segmentations(w[k:]):
                    yield (i, *rest), x + v.weight[i]

    weights = {s: np.exp(x) for s, x in segmentations("▁there")}
    total, n = sum(weights.values()), 40_000
    ids, count = v.sample([" there"] * n, np.arange(n))
    parts = collections.Counter(map(tuple, np.split(ids, np.cumsum(count)[:-1])))
    for s, w in weights.items():
        assert abs(parts[s] / n - w / total) < 5 * (w / total / n) ** 0.5 + 1e-3


# --- 9


def test_rollups(spark, tmp_path):
    row = "doc_id long, source string, lang string, n_tokens long"
    frame = lambda rows, version: spark.createDataFrame(rows, row).withColumn("tokenizer_version", F.lit(version))
    rollup = rollups.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    first = frame([(1, "a", "en", 10), (2, "a", "en", 5), (3, None, "de", 7), (4, "b", None, None), (4, "b", None, 2)], "v1")
    assert rollup.apply("1", inserts=first) and not rollup.apply("1", inserts=first)
    revised = frame([(2, "a", "en", 6), (3, "a", "de", 7), (9, "c", "fr", 1)], "v2")
    gone = spark.createDataFrame([(1,), (8,), (None,), (1,)], "doc_id long")
    # an attempt that failed before its commit leaves files, but no marker
    first.write.parquet(str(tmp_path / "r" / "batches" / "2-lost" / "changes"))
    for _ in range(2):
        rollup.apply("2", revisions=revised, deletes=gone)
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert found == {("a", "en", "v2"): (1, 6), ("a", "de", "v2"): (1, 7), ("c", "fr", "v2"): (1, 1), ("b", None, "v1"): (2, 2)}
    by_documents = rollup.documents().groupBy("source", "lang", "tokenizer_version").agg(F.sum("n_docs"), F.sum("n_tokens"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in by_documents.collect()} == found
    assert rollup.apply("3", deletes=spark.createDataFrame([(i,) for i in range(10)], "doc_id long")) and rollup.totals().count() == 0
    with pytest.raises(ValueError):
        rollup.apply("a/b")


def test_batches_at_the_same_time(spark, tmp_path):
    """A batch committed while another is worked out: the other sees it, and totals are as one after the other."""
    row = "doc_id long, source string, lang string, n_tokens long, tokenizer_version string"
    frame = lambda n: spark.createDataFrame([(1, "a", "en", n, "v")], row)
    folder = str(tmp_path / "r")
    one, two = rollups.Rollup(spark, folder), rollups.Rollup(spark, folder)
    assert one.apply("1", inserts=frame(10))
    write, tries = one._write, []

    def slow(changes, name):
        tries.append(name)
        out = write(changes, name)
        if len(tries) == 1:
            assert two.apply("3", revisions=frame(30))
        return out

    one._write = slow
    assert one.apply("2", revisions=frame(20)) and tries == ["2", "2"]
    assert [tuple(x) for x in one.totals().collect()] == [("a", "en", "v", 1, 20)] == [tuple(x) for x in two.totals().collect()]
    # two attempts at one batch: one winner
    tries.clear()
    one._write = lambda changes, name: (write(changes, name), tries or tries.append(two.apply("4", inserts=frame(5))))[0]
    assert not one.apply("4", inserts=frame(5)) and tries == [True]
    assert [tuple(x) for x in two.totals().collect()] == [("a", "en", "v", 2, 25)]


def test_snapshots(spark, tmp_path):
    row = "doc_id long, source string, lang string, n_tokens long, tokenizer_version string"
    frame = lambda *rows: spark.createDataFrame([(i, s, "en", n, "v") for i, s, n in rows], row)
    rollup = rollups.Rollup(spark, str(tmp_path / "r"))
    rollup.apply("1", inserts=frame((1, "a", 10), (2, "b", 5), (3, "b", 4)))
    rollup.apply("2", deletes=frame((2, "b", 5)))
    before = sorted(map(tuple, rollup.totals().collect()))
    assert rollup.snapshot() and sorted(map(tuple, rollup.totals().collect())) == before == [("a", "en", "v", 1, 10), ("b", "en", "v", 1, 4)]
    assert not rollup.apply("2", deletes=frame((1, "a", 10))) and rollup.apply("3", revisions=frame((3, "a", 6)))
    assert [tuple(x) for x in rollups.Rollup(spark, rollup.folder).totals().collect()] == [("a", "en", "v", 2, 16)]
    assert {(x.doc_id, x.n_tokens) for x in rollup.documents().collect()} == {(1, 10), (3, 6)}
    assert len(rollup.documents().inputFiles()) < 12 and rollup.apply("4", revisions=spark.createDataFrame([(3, None, None, None, "v")], row))
    assert sorted(map(str, map(tuple, rollup.totals().collect()))) == ["('a', 'en', 'v', 1, 10)", "(None, None, 'v', 1, 0)"]


def test_token_counts(spark):
    import tiktoken

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    count = tiktoken.Encoding("own", pat_str=rollups.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = corpus()
    found = {r.doc_id: r.n_tokens for r in rollups.token_counts(docs_of(spark, texts), path, "v").collect()}
    assert found == {i: len(count(t or "")) for i, t in enumerate(texts)}
    copies = {r.doc_id for r in rollups.exact_copies(docs_of(spark, texts)).collect()}
    assert copies == {i for i, t in enumerate(texts) if t is not None and texts.index(t) < i}


# --- 10

PAGE = """<!DOCTYPE html><html lang="EN"><head><title>A &amp; B
c</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><!-- no --><nav><a href="/x?a=1&amp;b">x</a> <a class=k href='y'>y</a></nav>
<p><b>Bold</b> text &lt;here&gt;<br>next<p>5 < 6</p><script>gone</body></html>"""


@pytest.mark.parametrize("part", ["<a ", "<a href=", '<a href="', "<head>", "<title>", "<script ", "<script>", "<!-- ", "<html ", "</head ", "<p ", "<", "&", "<a href='x'>"])
def test_hostile_pages_are_read_once(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    for x in (page, page + ">", "<a " + page + '">'):
        warc.plain_text(x), warc.title_of(x), warc.language_of(x), warc.links_of(x)
    assert time.process_time() - began < 12


def test_records_without_a_sound_length():
    sound = warc.to_warc({x: None for x in warc._NAMES} | {"warc_type": "response", "headers": {}, "block": b"xy"})
    for bad in ("x", "", "-3", "9" * 30, "1_0"):
        raw = sound + sound.replace(b"Content-Length: 2", f"Content-Length: {bad}".encode())
        assert [x["block"] for x in warc.from_warc(raw)] == [b"xy"]
    assert list(warc.from_warc(b"")) == list(warc.from_warc(b"WARC/1.1 and no more")) == []


def test_parsed_responses_keep_their_headers(spark):
    """From the bytes of a WARC file, with headers of its own, to derivatives."""
    http = b"HTTP/1.1 203 Other\r\nContent-Type: text/html; charset=x\r\nX-Own: 7\r\n\r\n<title>T</title><p>one<a href=u>two</a>"
    record = {x: None for x in warc._NAMES} | {"warc_type": "response", "record_id": "<urn:uuid:1>", "target_uri": "http://a/", "warc_date": "2020-02-02T00:00:00Z", "headers": {"WARC-IP-Address": "1.2.3.4"}, "payload_digest": "sha1:P", "block": http}
    other = record | {"warc_type": "request", "record_id": "<urn:uuid:2>"}
    raw = spark.createDataFrame([(warc.to_warc(other) + warc.to_warc(record),), (None,)], "warc binary")
    found = {x.warc_type: x for x in warc.derivatives(warc.parsed(raw)).collect()}
    assert set(found) == {"metadata", "conversion"} and {x.refers_to for x in found.values()} == {"<urn:uuid:1>"}
    assert bytes(found["conversion"].block) == b"Tonetwo" or bytes(found["conversion"].block) == b"T\nonetwo"
    assert found["conversion"].headers == {"WARC-Source-Content-Type": "text/html; charset=x", "WARC-Source-Payload-Digest": "sha1:P"}
    fields = bytes(found["metadata"].block).decode().split("\r\n")
    assert {"http-status: HTTP/1.1 203 Other", "http-header-x-own: 7", "title: T", "outlink: u"} <= set(fields)


def test_warc(spark):
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", ""), (3, "http://b/", ""), (4, "http://c/é", "plain\r\n\r\ntext <!-- open")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1))
    responses = warc.responses(pages)
    records = warc.derivatives(responses)
    by = collections.defaultdict(list)
    for r in records.collect():
        by[r.page_id, r.warc_type].append(r)
    source = {r.page_id: r for r in responses.collect()}
    assert {k: len(v) for k, v in by.items()} == {(i, t): 1 + (i == 3) for i in (1, 2, 3, 4) for t in ("metadata", "conversion")}
    text = by[1, "conversion"][0]
    assert bytes(text.block).decode() == "x y\nBold text <here>\nnext\n5 < 6" and bytes(by[4, "conversion"][0].block).decode() == "plain\ntext"
    meta = bytes(by[1, "metadata"][0].block).decode()
    assert "title: A & B c\r\n" in meta and "language: en\r\n" in meta and "outlink: /x?a=1&b\r\n" in meta and "outlink: y\r\n" in meta and "http-status: HTTP/1.1 200 OK" in meta
    for (i, _), found in by.items():
        for r in found:
            s = source[i]
            assert (r.refers_to, r.target_uri, r.warc_date) == (s.record_id, s.target_uri, s.warc_date) and r.block_digest == warc.digest(bytes(r.block)) and r.content_length == len(r.block)
    assert text.headers["WARC-Source-Payload-Digest"] == source[1].payload_digest == warc.digest(PAGE.encode()) and text.headers["WARC-Source-Content-Type"].startswith("text/html")
    every = responses.unionByName(records)
    raw = warc.serialised(every)
    again = warc.parsed(raw)
    order = lambda df: sorted((r.record_id, r.warc_type, r.refers_to or "", bytes(r.block), sorted(r.headers.items()), r.block_digest) for r in df.collect())
    assert order(again) == order(every)
    joined = spark.createDataFrame([(b"".join(bytes(r.warc) for r in raw.collect()) + b"WARC/1.1\r\nbroken",)], "warc binary")
    assert order(warc.parsed(joined)) == order(every)
    assert warc.derivatives(records).count() == 0 and warc.responses(pages.limit(0)).count() == 0
