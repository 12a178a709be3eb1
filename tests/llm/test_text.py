import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import rows

import ordinary

from folioscope.llm import bpe, chunks, mixing, prose, url_groups

VOCABULARY = "/opt/tokenizers"


# p3
def test_pieces(spark):
    rng = random.Random(1)
    words = lambda n: " ".join("w" * rng.randint(1, 12) for _ in range(n))
    texts = ["x" * 2500, words(900), "\n\n".join(words(30) + "." for _ in range(40)), "# H\r\n" + "\r\n".join(words(8) for _ in range(120)), "語。" * 900, "é́" * 1200, " " * 2000, "\n" * 1500, "😀" * 1300, "a" * 1000, "short", "", None]
    items = [("t", f"k{i}", 0, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(items + items[:2], "item_table string, item_key string, chunk_no int, text string, piece string")
    got = defaultdict(list)
    for r in chunks.split_items(df, 1000, 100).collect():
        got[r.item_key].append(r)
    assert set(got) == {f"k{i}" for i, t in enumerate(texts) if t and len(t) > 1000}
    for key, pieces in got.items():
        text, done = texts[int(key[1:])], ""
        for i, p in enumerate(sorted(pieces, key=lambda p: p.piece_no)):
            assert p.piece_no == i and len(p.piece) <= 1000 and p.item_chars == len(text)
            assert p.n_repeated == 0 if i == 0 else 75 <= p.n_repeated <= 100
            assert done.endswith(p.piece[: p.n_repeated]) and p.start == len(done) - p.n_repeated
            done += p.piece[p.n_repeated :]
        assert done == text


def test_cuts_at_the_strongest_boundary(spark):
    def cut(text):
        df = spark.createDataFrame([("t", "k", 0, text)], "item_table string, item_key string, chunk_no int, text string")
        return chunks.split_items(df, 100, 10).where("piece_no = 0").first()["piece"]

    fill = "word " * 9
    assert cut(fill * 1 + "z\n\n" + "word word\n# Head\n" + fill * 3).endswith("word word\n")
    assert cut(fill + "zzz\n\nword. word\n" + fill * 3).endswith("zzz\n\n")
    assert cut(fill + "zzz. word\nword. " + fill * 3).endswith("word\n")
    assert cut(fill + "zzz. word word " + fill * 3).endswith("zzz. ")
    assert cut("y" * 300) == "y" * 90


# p6
def test_urls(spark):
    urls = ["https://A.b/c?x=1&y=2", "https://a.b/c?y=2;x=1&", "HTTPS://ab/c?X=1&Y=2&x=1", "https://a.b/c?x1&y2", "https://a.b/c", "https://a.b/c?", "https://a.b/c?&;", "", "???", None, None, "Ü²?ß", "ü²?ß", "https://a.b/cx1y2"]
    data = list(enumerate(urls)) + [(0, urls[0]), (20, urls[0]), (None, urls[0])]

    def canon(u):
        head, _, tail = u.partition("?")
        bare = lambda s: "".join(c for c in s.lower() if c.isalnum())
        return bare(head), tuple(sorted(filter(None, map(bare, re.split("[&;]", tail)))))

    groups = defaultdict(set)
    for i, u in data:
        if u is not None and i is not None:
            groups[canon(u)].add(i)
    df = spark.createDataFrame([(i, u, "x") for i, u in data], "status_id long, url string, keep_id string")
    assert set(rows(url_groups.members(df))) == {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    kept = {r.keep_id: (r.n_rows, r.n_urls) for r in url_groups.collapsed(df).collect()}
    assert {k: v[0] for k, v in kept.items()} == {**{min(g): len(g) for g in groups.values()}, 9: 1, 10: 1} and kept[9] == (1, 0)
    assert url_groups.collapsed(df.limit(0)).count() == 0


# p7
@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    pytest.importorskip("public_tokenizers", reason="no tokenizers")
    import public_tokenizers

    with open(f"{VOCABULARY}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids(spark, tokenizer):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab aé　中\n\x1c\x85\xa0'sltre012²½_😀𝒳\r\t") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += ["<|endoftext|>", "don't we'll I'M", "a" * 5000, "ab" * 4000 + "xyz" * 3000, "\n" * 300, " " * 301 + "x"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {**{i: tokenizer.encode_ordinary(t) for i, t in enumerate(texts)}, len(texts): [], len(texts) + 1: []}
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.limit(0)).count() == 0


def test_cache_generations(tokenizer):
    e = bpe.Encoder(bpe.encoder(VOCABULARY, "byte_bpe_50k").ranks, entries=3)
    text = "alpha beta gamma delta epsilon alpha zeta beta"
    assert e.encode(text) == tokenizer.encode_ordinary(text) and len(e) <= 3 and len(e.old) <= 3


def test_no_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    assert bpe.encode_bytes(b"abcab", ranks) == [258, 256] and bpe.encode_bytes(b"x", ranks) == [120]


# p8
def test_budgets():
    leaves = [(("d", "en", "a"), 0.5, 100.0), (("d", "en", "b"), 0.1, 1000.0), (("d", "de", "c"), 0.4, 1000.0)]
    got = mixing.budgets(leaves, 1000)
    assert got == pytest.approx({("d", "en", "a"): 100, ("d", "en", "b"): 500, ("d", "de", "c"): 400})  # the sibling takes the shortage
    got = mixing.budgets([(("x", "a"), 0.5, 10.0), (("x", "b"), 0.1, 20.0), (("y", "c"), 0.4, 900.0)], 1000)
    assert got == pytest.approx({("x", "a"): 10, ("x", "b"): 20, ("y", "c"): 900})
    assert sum(mixing.budgets([(("a",), 0.0, 50.0), (("b",), 1.0, 30.0)], 100).values()) == 30
    assert mixing.budgets([], 10) == {}


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, s, rng.randint(1, 40)) for i, s in enumerate(["big"] * 600 + ["mid"] * 200 + ["tiny"] * 10 + ["other"] * 50)] + [(900, "big", 0)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("none", 0.1, 2), ("big", 0.5, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    leaves, total = mixing.plan(counted, targets, ["source"])
    sums = Counter()
    for _, s, n in docs:
        sums[s] += n
    assert total == sums["big"] + sums["mid"] + sums["tiny"]
    mixed = mixing.mix(counted, leaves, ["source"])
    got = [tuple(r) for r in mixed.select("doc_id", "source", "n_tokens", "copies").collect()]
    assert len({g[0] for g in got}) == len(got) and 900 not in {g[0] for g in got}
    assert max(c for _, s, _, c in got if s == "tiny") <= 3 and all(c == 1 for _, s, _, c in got if s == "big")
    used = Counter()
    for _, s, n, c in got:
        used[s] += n * c
    for x in leaves:
        (s,) = x["path"]
        assert x["budget"] - 40 < used[s] <= x["budget"] or used[s] == x["budget"]
    out = {r.source: r for r in mixing.shares(mixed, leaves, total, ["source"]).collect()}
    assert out["none"].actual_tokens == 0 and abs(sum(r.actual_share for r in out.values()) - 1) < 1e-9
    assert [tuple(r) for r in mixing.mix(counted.repartition(7), leaves, ["source"]).select("doc_id", "source", "n_tokens", "copies").collect()].sort() == got.sort()
    empty, none = mixing.plan(counted.limit(0), targets, ["source"])
    assert none == 0 and mixing.mix(counted.limit(0), empty, ["source"]).count() == 0


# p9
def page(rng, n):
    nouns = ["mirror", "ledger", "parser", "index", "folder", "window", "garden", "signal", "harbour", "letter", "bridge", "market"]
    forms = ["If the {} is empty, the {} falls back to the {} and logs a warning.", "You can open the {} at any time, but the {} keeps its value until the next {}.", "Nobody noticed the {} until the {} of the {} failed twice.", "We found that a {} slows the {} down by about 40 percent of the {}.", "In version 3 the {} was renamed, and the {} was removed from the {}."]
    return " ".join(rng.choice(forms).format(*rng.sample(nouns, 3)) for _ in range(n))


def test_spam(spark):
    rng = random.Random(9)
    good = [page(rng, 8) for _ in range(60)]
    good += ["# Title\n\n- [a](#b)\n- [c](#d)\n\n" + page(rng, 6), "```\n" + "x = 1\n" * 40 + "```\n" + page(rng, 2), "| a | b |\n|---|---|\n" + "| x | y |\n" * 30 + page(rng, 2), "\n".join(f"- [x y](https://a.example/{i}): " + page(rng, 1) for i in range(9)), page(rng, 6).upper()]
    bad = ["\n".join(f"- [best cheap tool](https://x.example/{i})" for i in range(40)), "best, cheap, tool, best, cheap, tool\n" * 30, " ".join(f"#tag{i}" for i in range(80)), "\n".join(f"https://x{i}.example/a?id={i}" for i in range(40)), "\n".join(f"ABC-{i} | red | {i}.99" for i in range(100, 140)), "Looking for cheap tool or cheap tool? This cheap tool page has cheap tool. " * 20, "Home » Shop\nShop Garden » Bridge\nMarket » Letter\n" * 12, " &middot; ".join('<a href="/a">b c</a>' for _ in range(40)), page(rng, 1) + "\n\n" + "best free download plugin\n" * 40]
    texts = good + bad + ["", None, "  \n "]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, odd_share double")
    assert {r.doc_id for r in prose.spam(df).collect()} == set(range(len(good), len(good) + len(bad)))
    assert prose.spam(df.limit(0)).count() == 0


def test_spam_counts_every_distinct_text(spark):
    rng = random.Random(4)
    texts = [page(rng, 2) for _ in range(2500)] + ["Der Schlüssel ist noch in der Tür, und niemand hat ihn dort bis jetzt gesehen."]
    copies = [t for t in texts for _ in range(3)]
    once, thrice = (spark.createDataFrame(list(enumerate(x)), "doc_id long, text string") for x in (texts, copies))
    want = {r.doc_id: (r.odd_share, r.bits) for r in prose.spam_scores(once).collect()}
    got = {r.doc_id: (r.odd_share, r.bits) for r in prose.spam_scores(thrice).collect()}
    assert len(got) == len(copies) and all(got[i] == pytest.approx(want[i // 3], abs=1e-9) for i in got)


def test_spam_model_is_exact(spark):
    """Bits equal those of plain counting: contexts of no to three classes and of two symbols, each with its back-off."""
    rng = random.Random(5)
    texts = [page(rng, 3) for _ in range(120)]
    cls = lambda x: int(prose._CLASS_OF[min(x, prose._KANA)])
    start, end = prose._KIND["start"], prose._KIND["end"]

    def steps(code):
        x = [start] * 3 + code + [end]
        for i in range(3, len(x)):
            c = [cls(v) for v in x[: i + 1]]
            yield ((), (c[i - 1],), (c[i - 2], c[i - 1]), (c[i - 3], c[i - 2], c[i - 1]), ("ids", x[i - 2], x[i - 1])), c[i]

    counts = {}
    for t in set(texts):
        if hashlib.sha256(t.encode()).digest()[0] < prose.HELD_OUT:
            continue
        for piece in re.split(r"(?<=\.) ", t):
            s, content = prose.symbols(piece)
            if prose._sentence(piece, s, content):
                for contexts, c in steps(s):
                    for x in contexts:
                        counts.setdefault(x, Counter())[c] += 1
    line = "If the mirror is empty, the ledger falls back"
    df = spark.createDataFrame([*enumerate(texts), (999, line)], "doc_id long, text string")
    s, bits = prose.symbols(line)[0], 0.0
    for contexts, c in steps(s):
        p = 1 / len(prose._CLASSES)
        for x in contexts:
            if x in counts:
                n, others = sum(counts[x].values()), 4 + len(counts[x])
                w = max(prose.BACK_OFF, others / (n + others))
                p = (1 - w) * counts[x][c] / n + w * p
        bits -= math.log2(p)
    got = {r.doc_id: r.bits for r in prose.spam_scores(df).collect()}
    assert got[999] == pytest.approx(bits / (len(s) + 1), rel=1e-5)


def test_ordinary_prose_of_other_sources(spark, tiny):
    """A model of the test data leaves prose that it has never seen alone, in thirteen languages, and finds stuffing in others."""
    table = prose.parsed(spark.read.parquet(f"{tiny}/documents.parquet"))
    model, limits = prose.train(table)
    good = [p for text in ordinary.PARAGRAPHS.values() for p in text.split("\n")]
    assert len(good) >= 100
    bad = [
        "купить дешёвый телефон москва, купить телефон москва цена, телефон москва дешёвый купить, купить телефон цена москва, " * 6,
        "дешёвые окна москва. окна москва купить. купить дешёвые окна москва. окна цена москва. " * 6,
        "휴대폰 최저가 구매 서울 휴대폰 최저가 할인 구매 서울 휴대폰 구매 최저가 " * 8,
        "Kaufen Sie billige Schuhe, denn billige Schuhe sind billige Schuhe, und wer billige Schuhe sucht, findet billige Schuhe. " * 5,
        "手机 电脑 便宜 手机 优惠 电脑 便宜 手机 优惠 " * 12,
        "\n".join(f"Товар {i} | красный | {i}90 руб" for i in range(40)),
        "\n".join(f"[раздел {i}](https://пример.example/{i})" for i in range(30)),
    ]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    found = {r.doc_id for r in prose.scored(prose.parsed(df), model, limits).where("odd_share > 0.5").collect()}
    wrong = sorted(i for i in found if i < len(good))
    assert len(wrong) <= 0.02 * len(good), [good[i] for i in wrong]
    assert found >= set(range(len(good), len(good) + len(bad))), [bad[i - len(good)] for i in range(len(good), len(good) + len(bad)) if i not in found]


def test_spam_abstains_without_prose(spark):
    df = spark.createDataFrame([(1, "aaa bbb\n" * 40), (2, "kkk | lll | mmm\n" * 30), (3, None)], "doc_id long, text string")
    assert prose.spam(df).count() == 0


def test_rare_pairs_of_symbols_count(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    scores = lambda: {r.doc_id: (r.odd_share, r.bits, r.own_bits) for r in prose.spam_scores(docs).collect()}
    whole = scores()
    for kept in (0, 50):  # of the pairs, so many go to the driver; all others are joined
        monkeypatch.setattr(prose, "KEPT", kept)
        assert scores() == whole
