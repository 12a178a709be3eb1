from conftest import rows
from pyspark.sql import functions as F

from folioscope.functions import anchors, globs, paths, similarity
from folioscope.operators import fixes, links, owners, reports, snippets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_paths(spark):
    for path, want in [("a/./b/../c", "a/c"), ("../x", "../x"), ("a/../../x", "../x"), ("/a/../../x", "/x"), ("a//b/", "a/b"), ("", "."), ("a/b.md", "a/b.md")]:
        assert one(spark, paths.normalise(F.lit(path))) == want


def test_slugs(spark):
    for text, want in [("Hello World", "hello-world"), ("What's new?", "whats-new"), ("a  b", "a-b"), ("", ""), ("API: v2.0", "api-v20"), ("Über uns", "über-uns"), ("-x-", "x"), ("snake_case", "snake_case")]:
        assert one(spark, anchors.slug(F.lit(text))) == want
    assert one(spark, anchors.variants(F.lit("Foo (bar) baz"))) == ["foo-bar-baz"]
    assert one(spark, anchors.variants(F.lit("A . B"))) == ["a-b", "a--b"]
    assert one(spark, anchors.variants(F.lit(None).cast("string"))) == []


def test_check_internal(spark):
    files = spark.createDataFrame([("r/a.md",), ("r/docs/b.md",), ("r/src/x.py",)], "path string")
    heads = spark.createDataFrame([("r/a.md", 0, "One"), ("r/a.md", 1, "One"), ("r/docs/b.md", 0, "Two"), ("r/a.md", 2, None)], "doc_path string, ord int, text string")
    urls = ["docs/b.md", "docs/b", "docs", "docs/c.md", "docs/c", "#one", "#one-1", "#one-2", "#zzz", "docs/b.md#two", "docs/b.md#three", "/docs/b.md#nope", "/gone", "tel:1", None, "src/x.py#L3"]
    data = spark.createDataFrame([(i, "r/a.md", "r", u) for i, u in enumerate(urls)], "link_id int, doc_path string, base_path string, url string")
    got = {r.link_id: r for r in links.check_internal(data, files, heads).collect()}
    broken = {i for i, r in got.items() if r.status == "broken"}
    assert {urls[i] for i in broken} == {"docs/c.md", "docs/c", "#one-2", "#zzz", "docs/b.md#three", "/gone", "tel:1"}
    assert got[4].suggestion == "Did you mean docs/c.md?" and got[3].suggestion is None
    assert got[7].suggestion == "Did you mean #one?" and "outdated" in got[7].error_message
    near = links.suggest_anchors(spark.createDataFrame([(1, "r/a.md", "onee"), (2, "r/a.md", "qqq")], "link_id int, doc_path string, anchor string"), heads)
    assert rows(near) == [(1, "Did you mean #one?")]


def test_probe_status(spark):
    log = [("a", 1, 503, None), ("a", 2, 200, None), ("b", 1, 404, None), ("b", 2, 200, None), ("c", 1, None, "Timeout"), ("c", 2, None, "timeout"), ("d", 1, 503, None), ("d", 2, 503, None), ("d", 3, 503, None), ("d", 4, 200, None), ("e", 1, None, "refused")]
    got = rows(links.probe_status(spark.createDataFrame(log, "url string, attempt int, status_code int, error string")), "url", "status")
    assert got == [("a", "ok"), ("b", "broken"), ("c", "timeout"), ("d", "broken"), ("e", "error")]


def test_owners(spark):
    rules, default = owners.parse_rules("* @all\n# x\n/docs/ @d @e # y\n*.md @m\nlone\ndocs/**/z @z no\n!src @n\n* @last\n")
    assert [r["pattern"] for r in rules] == ["/docs/", "*.md", "docs/**/z", "!src"] and default == ["@last"]
    files = spark.createDataFrame([(p,) for p in ["docs/a.txt", "docs/a.md", "x/docs/a.txt", "docs/q/z/f", "./docs/a.txt", "src/a.md", ".github/x"]], "doc_path string")
    got = {r.doc_path: r.owner_key for r in owners.keyed(files, rules, default).collect()}
    assert got == {"docs/a.txt": "@d,@e", "docs/a.md": "@m", "x/docs/a.txt": "@last", "docs/q/z/f": "@z", "./docs/a.txt": "@d,@e", "src/a.md": "_no_owner_", ".github/x": "@last"}
    assert one(spark, owners.branch_name(F.array(F.lit("@a_b/c!")))) == "docs/fix-a-b-c"
    assert one(spark, owners.branch_name(F.array().cast("array<string>"))) == "docs/fix-no-owner"


def test_globs(spark):
    for path, pattern, want in [("a/b/c.md", "*.md", True), ("a/b.txt", "b.*", True), ("x/node_modules/y", "**/node_modules/**", True), ("a.md", "b.md", False), ("ab.md", "a?.md", True)]:
        assert one(spark, globs.excluded(F.lit(path), [pattern])) is want


def test_fixes(spark):
    files = spark.createDataFrame([("d/Guide.md",), ("d/b.md",)], "path string")
    kind = "link_id int, doc_path string, base_path string, line int, url string, suggestion string, error_message string"
    broken = [
        (1, "d/a.md", "d", 1, "b", None, None), (2, "d/a.md", "d", 2, "#A--b", "Did you mean #a-b?", None), (3, "d/a.md", "d", 2, "b.md#x", "Did you mean #quite-other?", None),
        (4, "d/a.md", "d", 3, "guide.md", None, None), (5, "d/a.md", "d", 4, "https://x.example", None, "HTTP 404"), (6, "d/a.md", "d", 5, "zip.zip", None, None), (7, "d/a.md", "d", 5, None, None, None),
    ]
    proposed = fixes.propose(spark.createDataFrame(broken, kind), files)
    got = {r.link_id: (r.suggested_url, r.auto_fixable) for r in proposed.collect()}
    assert got == {1: ("b.md", True), 2: ("#a-b", True), 3: ("#quite-other", False), 4: ("./Guide.md", True), 5: ("https://x.example", False)}
    docs = spark.createDataFrame([("d/a.md", "see [b](b) b\n[q](#A--b)\n[g](guide.md)\n"), ("d/z.md", "same")], "doc_path string, content string")
    r = fixes.apply(docs, proposed).collect()
    assert [(x.fixed_content, x.attempted, x.succeeded) for x in r] == [("see [b.md](b) b\n[q](#a-b)\n[g](./Guide.md)\n", 3, 3)]
    for a, b, want in [("Foo", "foo", True), ("a--b", "a-b", True), ("-a-", "a", True), ("abc", "abd", False)]:
        assert one(spark, fixes.is_safe(F.lit(a), F.lit(b))) is want


def test_reports(spark):
    data = [("d", 1, 'a"b', 3, "broken", None, "No|pe", None), ("d", 0, "u", 2, "ok", 200, None, None), ("e", 0, None, 1, None, None, None, None)]
    df = spark.createDataFrame(data, "doc_path string, ord int, url string, line int, status string, status_code int, error_message string, suggestion string")
    assert rows(reports.link_json(df)) == [("d", '{"path":"d","broken":1,"links":[{"url":"u","line":2,"status":"ok","status_code":200},{"url":"a\\"b","line":3,"status":"broken","status_code":null,"error":"No|pe"}]}')]
    assert "No\\|pe" in reports.link_markdown(df).first()["markdown"]


def test_snippets(spark):
    body = "def alpha(x):\n    y = x + 1\n    return y * 2\n"
    symbols = spark.createDataFrame(
        [(1, "s/u.py", 0, "alpha", 1, body), (2, "s/v.py", 0, "alpha", 1, "def alpha():\n    pass\n"), (3, "s/w.py", 0, "beta", 1, "class Beta:\n    value = 'something long enough'\n    other = 12345\n")],
        "symbol_id int, file_path string, ord int, name string, start_line int, code string",
    )
    blocks = spark.createDataFrame(
        [
            (1, "d", "python", body, None, ["alpha"]), (2, "d", "python", body.replace("2", "3"), "s/v.py", ["alpha"]), (3, "d", "python", "class Beta:\n    value = 'something long enuf'\n    other = 12345\n", None, []),
            (4, "d", "python", "  ", None, []), (5, "d", None, body, None, ["alpha"]), (6, "d", "go", "zzzzqqqq", None, ["none"]),
        ],
        "code_id int, doc_path string, language string, code string, file_hint string, symbols array<string>",
    )
    got = {r.code_id: (r.status, r.strategy, r.source_path) for r in snippets.validate(blocks, symbols).collect()}
    assert got[1] == ("valid", "symbol_name", "s/u.py") and got[2] == ("outdated", "file_hint", "s/v.py") and got[3] == ("valid", "content", "s/w.py")
    assert {got[i][0] for i in (4, 5, 6)} == {"not_found"}
    text = "a\n```py\nold\n```\nb\n````\nx\n````\n"
    fixed = snippets.rewrite(spark.createDataFrame([("d", text)], "doc_path string, content string"), spark.createDataFrame([("d", 2, "new\nmore\n"), ("d", 6, "y"), ("d", 1, "no")], "doc_path string, line int, code string")).first()
    assert (fixed.fixed_content, fixed.n_fixed) == ("a\n```py\nnew\nmore\n```\nb\n````\ny\n````\n", 2)


def test_similarity(spark):
    import difflib

    a, b = "abcdef" * 40, "abcxef" * 40
    assert one(spark, similarity.ratio(F.lit(a), F.lit(b))) == difflib.SequenceMatcher(None, a, b).ratio()
    assert one(spark, similarity.code_similarity(F.lit("ab"), F.lit("xabx"))) == 0.5
    assert one(spark, similarity.code_similarity(F.lit(""), F.lit(""))) is None
    assert one(spark, similarity.normalise_code(F.lit("\n  # c\n x  \n\n// y\n z\n"))) == " x\n z"
    assert one(spark, similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_suggestions_in_other_pages(spark):
    from folioscope import engine

    docs = spark.createDataFrame(
        [("r/a.md", "r", "# Alpha\n\n[x](b.md#instal) [y](b#usag) [z](#alpa) [q](b.md#zzzzzz) [ok](b.md#usage) [f](/b.md#instal) [g](gone.md#usag)\n"), ("r/b.md", "r", "# Install\n\n# Usage\n")],
        "doc_path string, base_path string, content string",
    )
    got = {r.text: (r.status, r.suggestion) for r in engine.scan(docs, docs.selectExpr("doc_path as path")).collect()}
    assert got["x"] == ("broken", "Did you mean #install?") and got["y"] == ("broken", "Did you mean #usage?") and got["z"] == ("broken", "Did you mean #alpha?")
    assert got["q"] == got["g"] == ("broken", None) and got["ok"] == got["f"] == ("ok", None)


def test_content_matching_is_exact(spark, tiny):
    import difflib

    from folioscope.plans import documents

    s = spark.read.parquet(f"{tiny}/symbols.parquet").dropDuplicates(["code_id"]).where("code is not null")
    source = {r.code_id: (r.c, (r.file_path.split("/"), r.ord)) for r in s.select("code_id", "file_path", "ord", similarity.normalise_code(F.col("code")).alias("c")).collect()}
    b = spark.read.parquet(f"{tiny}/code_blocks.parquet").dropDuplicates(["code_id"]).where(r"code rlike '\\S' and coalesce(language, '') <> ''")
    codes = {r.code_id: r.c for r in b.select("code_id", similarity.normalise_code(F.col("code")).alias("c")).collect()}
    path = {r.code_id: r.file_path for r in s.collect()}
    whole = snippets.validate(spark.read.parquet(f"{tiny}/code_blocks.parquet").dropDuplicates(["code_id"]), s.withColumnRenamed("code_id", "symbol_id"))
    got = {r.code_id: r for r in whole.withColumn("similarity", F.round("similarity", 6)).collect()}
    fast = {r.code_id: r for r in documents.snippet_status(spark, tiny).collect()}
    free = [i for i in codes if got[i].strategy in (None, "content")]
    assert any(got[i].strategy == "content" for i in free)
    for i in free:
        x, best = codes[i], (0.0, None)
        for k, (y, key) in source.items():
            if x in y or y in x:
                r = min(len(x), len(y)) / max(len(x), len(y), 1)
            else:
                m = difflib.SequenceMatcher(None, x, y)
                r = m.ratio() if m.real_quick_ratio() >= 0.3 and m.quick_ratio() >= 0.3 else 0.0
            if best[1] is None or (-r, key) < (-best[0], source[best[1]][1]):
                best = (r, k)
        if best[0] >= 0.3:
            assert got[i].similarity == round(best[0], 6) and got[i].source_path == path[best[1]]
            # the query compares only codes with stretches in common: it finds every match from 0.5 on, and never a better one
            assert fast[i].similarity == got[i].similarity if best[0] >= 0.5 else fast[i].similarity <= got[i].similarity
        else:
            assert got[i].status == fast[i].status == "not_found"


def test_every_content_match_is_found(spark, tiny):
    from folioscope.plans import documents

    s = spark.read.parquet(f"{tiny}/symbols.parquet").dropDuplicates(["code_id"]).withColumnRenamed("code_id", "symbol_id")
    whole = snippets.validate(spark.read.parquet(f"{tiny}/code_blocks.parquet").dropDuplicates(["code_id"]), s)
    want = {(r.code_id, r.status, round(r.similarity, 6), r.source_path) for r in whole.collect()}
    assert {(r.code_id, r.status, r.similarity, r.source_path) for r in documents.snippet_status(spark, tiny).collect()} == want


def test_similarities_of_all_pairs(spark):
    import difflib
    import random

    from folioscope.functions import sequences

    rng = random.Random(5)
    mk = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    data = []
    for letters in ("ab", "abcdefgh XY", "eeeeeeeeeeeeetttttttaaaa  xyzw(){}=;😀"):
        base = mk(letters, 400)
        data.append(([mk(letters, rng.randint(0, 500)) for _ in range(12)] + [base[50:250] + mk(letters, 60), "", "e", "e" * 150], [mk(letters, 150), mk(letters, 600), base, mk(letters, 50) + base[50:350], ""]))
    sequences.register(spark)
    df = spark.createDataFrame(data, "a array<string>, b array<string>")
    for least in (0.0, 0.3):
        for r in df.select("a", "b", sequences.alike(F.col("a"), F.col("b"), least).alias("o")).collect():
            got = {(int(r.o[k]), int(r.o[k + 1])): r.o[k + 2] for k in range(0, len(r.o), 3)}
            like = lambda x, y: min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else difflib.SequenceMatcher(None, x, y).ratio()
            want = {(i, j): v for i, x in enumerate(r.a) for j, y in enumerate(r.b) if x and y and (v := like(x, y)) >= least}
            assert got == want


def test_similarities_beyond_a_group(spark):
    import difflib
    import random

    from folioscope.functions import sequences

    rng = random.Random(7)
    words = ["return ", "self.", "(x)", "{\n    ", "}\n", " == ", "Value", "queueReload", "47", "9031", "é", "😀", "if ", "for ", "\n"]
    mk = lambda n: "".join(rng.choice(words) for _ in range(n))
    a, b = ([mk(rng.randint(0, 60)) for _ in range(66)] for _ in range(2))
    a += [b[0] + mk(9), b[1][3:], "x" * 64, "ab" * 100]
    b += [a[2] + mk(5), a[3][:-4], "x" * 128, "ab" * 130]
    sequences.register(spark)
    o = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(sequences.alike(F.col("a"), F.col("b"), 0.3).alias("o")).first().o
    got = {(int(o[k]), int(o[k + 1])): o[k + 2] for k in range(0, len(o), 3)}
    like = lambda x, y: min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else difflib.SequenceMatcher(None, x, y).ratio()
    assert got == {(i, j): v for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (v := like(x, y)) >= 0.3}


def test_similarities_take_little_time(spark, tiny):
    import difflib
    import random
    import time

    from folioscope.functions import sequences

    rng = random.Random(9)
    lines = [x for r in spark.read.parquet(f"{tiny}/symbols.parquet").where("code is not null").select("code").collect() for x in r.code.split("\n") if x.strip()]
    mk = lambda: "\n".join(rng.choice(lines) for _ in range(rng.randint(8, 40)))
    a, b = ([mk() for _ in range(700)] for _ in range(2))
    sequences.register(spark)
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(F.size(sequences.alike(F.col("a"), F.col("b"), 0.3)))
    began = time.perf_counter()
    df.collect()
    mine, began = (time.perf_counter() - began) / 700**2, time.perf_counter()
    for x, y in zip(a[:100], b):
        difflib.SequenceMatcher(None, x, y).ratio()
    assert mine < (time.perf_counter() - began) / 100 / 120
