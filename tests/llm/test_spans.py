import random
from collections import defaultdict

import pytest

from folioscope.llm import spans

KIND = "code_id long, code string"


def brute(rows, n=120):
    grams, covered, pairs = defaultdict(set), defaultdict(set), set()
    for i, c in {(i, c) for i, c in rows if c is not None}:
        for p in range(len(c) - n + 1):
            grams[c[p : p + n]].add((i, p))
    for places in grams.values():
        ids = sorted({i for i, _ in places})
        if len(ids) > 1:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
            for i, p in places:
                covered[i] |= set(range(p, p + n))
    return pairs, {i: len(v) for i, v in covered.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdef \n") for _ in range(n))
    head, near, over, period = text(200), text(119), text(121), "ab" * 200
    rows = []
    for i in range(120):
        t = text(rng.randint(0, 300))
        t = head + t if i % 3 == 0 else t
        t = t + near + text(50) if i % 4 == 0 else t
        t = text(30) + over + t if i % 5 == 0 else t
        t = t + period[: rng.randint(100, 400)] + text(rng.randint(0, 50)) if i % 10 == 7 else t
        t = "é日😀" * 60 + t if i % 11 == 0 else t
        rows.append((i, t))
    return rows + [(200 + i, rows[3 * i][1]) for i in range(20)] + [rows[5], (300, None), (301, ""), (None, head)]


@pytest.mark.parametrize("cold", [3, 48])
def test_exact(spark, corpus, cold):
    df = spark.createDataFrame([(i, c, 1) for i, c in corpus], KIND + ", cid int").drop("x")
    want, covered = brute([r for r in corpus if r[0] is not None])
    rows = spans.records(df, df.limit(0))
    got = [tuple(r) for r in spans.pairs(rows, cold=cold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    shared = {r.code_id: r.shared_chars for r in spans.coverage(rows, cold=cold).collect()}
    assert shared == {i: covered.get(i, 0) for i, c in corpus if i is not None and c is not None}


@pytest.mark.parametrize("cold", [3, 48])
def test_classes_and_their_links(spark, corpus, cold):
    df = spark.createDataFrame([(i, c) for i, c in corpus if i is not None], KIND)
    text = {i: c for i, c in corpus if i is not None and c is not None and len(c) >= 120}
    by_text = defaultdict(set)
    for i, c in text.items():
        by_text[c].add(i)
    pairs, _ = brute(list(text.items()))
    links = {c: {text[b if text[a] == c else a] for a, b in pairs if c in (text[a], text[b]) and text[a] != text[b]} for c in by_text}
    got = {r.code_id: (r.class_id, r.n_copies, r.n_links) for r in spans.linked(spans.records(df), cold=cold).collect()}
    assert got == {i: (min(by_text[c]), len(by_text[c]), len(links[c])) for i, c in text.items()}


def test_parse_goes_on_across_batches(spark):
    places = [(1, 2, 5, 10 * i, 10 if i % 4 != 3 else 0) for i in range(40)] + [(1, 3, 0, 0, 7), (1, 3, 0, 8, 0), (2, 3, 1, 0, 5), (2, 3, 1, 5, 0)]
    df = spark.createDataFrame(places, "a long, b long, shift int, pa int, gap int")
    want = [(1, 2, 5, 40 * i, 40 * i + 30) for i in range(10)] + [(1, 3, 0, 0, 0), (1, 3, 0, 8, 8), (2, 3, 1, 0, 5)]
    for size in (1, 3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(tuple(r) for r in spans.parsed(df).collect()) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spans.parsed(df.limit(0)).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "_BLOCK", 64)
    rng = random.Random(2)
    a, b = "".join(map(chr, rng.choices(range(97, 123), k=3000))), "".join(map(chr, rng.choices(range(97, 123), k=900)))
    texts = [a, b + a[700:830] + b]
    pieces = [p for t in texts for p in spans._pieces(t, 120)]
    assert all(len(p) <= 512 for _, p in pieces)
    found = [set(spans.anchors([p for _, p in spans._pieces(t, 120)], 120, 30)[2].tolist()) for t in texts]
    whole = [set(spans.anchors([t], 120, 30)[2].tolist()) for t in texts]
    assert found == whole and found[0] & found[1]


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert spans.pairs(none).count() == 0 and spans.coverage(none).count() == 0
