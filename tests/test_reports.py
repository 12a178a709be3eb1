"""Reports, plans, routes and the parts of the core that answer for them, on small fixtures."""

import json

from conftest import rows

from folioscope.operators import fixes, links, owners, reports, semantic, snippets
from folioscope.sources import caches
from folioscope.session import once, spread_join


def results(spark):
    data = [
        (1, "d/a.md", 0, 'x"y', 3, "broken", 404, "HTTP 404", None, "@a"), (2, "d/a.md", 1, "b|c", 4, "ok", None, None, "", "@a"),
        (3, "d/b.md", 0, "u", 1, "ok", 200, None, None, "_no_owner_"), (4, "d/b.md", 1, None, 1, "broken", None, None, None, "_no_owner_"),
        (5, "d/c.md", 0, "v", 1, None, None, None, None, "@a"),
    ]
    return spark.createDataFrame(data, "link_id long, doc_path string, ord int, url string, line int, status string, status_code int, error_message string, suggestion string, owner_key string")


def test_json_report(spark, tmp_path):
    df = results(spark)
    parts = reports.scan_json(df)
    by = {}
    for r in parts.collect():
        by.setdefault(r.part, {}).setdefault(r.name, []).append(json.loads(r.text))
    assert by["summary"][""] == [{"files_checked": 3, "total_links": 5, "broken_links": 2, "ok_links": 2}]
    assert by["owner"] == {"@a": [{"owner": "@a", "broken_count": 1, "n_files": 2}], "_no_owner_": [{"owner": "_no_owner_", "broken_count": 1, "n_files": 1}]}
    assert sorted(by["owner_file"]["@a"]) == ["d/a.md", "d/c.md"]
    assert by["file"]["d/a.md"][0]["links"][0] == {"url": 'x"y', "line": 3, "status": "broken", "status_code": 404, "error": "HTTP 404"}
    assert by["file"]["d/a.md"][0]["links"][1] == {"url": "b|c", "line": 4, "status": "ok", "status_code": None}
    reports.write_report(parts, f"file:{tmp_path}/report")
    assert spark.read.text(f"file:{tmp_path}/report").count() == parts.count()
    assert [json.loads(r.text)["total_links"] for r in reports.scan_json(df.limit(0)).where("part = 'summary'").collect()] == [0]


def test_markdown_and_snippet_reports(spark):
    got = {(r.part, r.name): r.text for r in reports.scan_markdown(results(spark)).collect()}
    assert "| Broken | 2 |" in got["summary", ""] and got["file", "d/a.md"].endswith('| 3 | `x"y` | HTTP 404 |') and len(got) == 2
    snips = spark.createDataFrame([("a", 0, 5, "valid", 1.0, "s/x.py"), ("a", 1, 9, "outdated", 0.6505, None), ("b", 0, None, None, None, None), ("b", 1, 2, "not_found", 0.0, None)], "doc_path string, ord int, line int, status string, similarity double, source_path string")
    parts = {(r.part, r.name): json.loads(r.text) for r in reports.snippet_json(snips).collect()}
    assert parts["summary", ""] == {"total": 3, "valid": 1, "outdated": 1, "not_found": 1, "invalid_syntax": 0}
    assert [x["source"] for x in parts["file", "a"]["snippets"]] == ["s/x.py", None] and parts["file", "a"]["snippets"][1]["similarity"] == 0.6505
    text = dict(rows(reports.snippet_markdown(snips)))
    assert text == {"a": "- line 9: outdated (65.0%)", "b": "- line 2: not_found (0.0%)"}  # as printf rounds 65.05


def test_exit_codes(spark):
    df = results(spark)
    snips = spark.createDataFrame([("outdated",), (None,)], "status string")
    none = spark.createDataFrame([], "id int")
    assert dict(rows(reports.exit_codes(df, snips, none, none))) == {"scan": True, "validate-snippets": True, "semantic": False}
    assert dict(rows(reports.exit_codes(df.where("status = 'ok'"), snips, none, spark.createDataFrame([(1,)], "id int"), fixed=True))) == {"scan": False, "validate-snippets": False, "semantic": True}
    assert dict(rows(reports.exit_codes(df.limit(0), snips.limit(0), none))) == {"scan": False, "validate-snippets": False, "semantic": False}


def test_plan_parts(spark):
    kind = "link_id long, file_path string, line int, original_url string, suggested_url string, auto_fixable boolean, owner_key string"
    df = spark.createDataFrame([(i, f"f{i % 2}", i, f"u{i}", "n", i != 3, "@a") for i in range(15)] + [(99, "g", 1, "z", "n", False, "@b")], kind)
    first = owners.first_fixes(df, 10)
    assert first.count() == 10 and [r.file_path for r in first.orderBy("n").collect()] == ["f0"] * 8 + ["f1"] * 2
    assert rows(first.where("n = 1"), "owner_key", "file_path", "line") == [("@a", "f0", 0)]
    broken = spark.createDataFrame([(1, "d/a", "u1", "@a"), (50, "d/b", "u1", "@b"), (3, "d/c", "u3", "@a"), (51, "d/c", None, "@a")], "link_id long, doc_path string, url string, owner_key string")
    assert rows(fixes.remaining(broken, df), "link_id") == [(3,), (51,)]  # by url: 50 has one that is fixed elsewhere
    assert rows(owners.fixable(broken, df)) == [("@a", 3, 1, 2, 1), ("@b", 1, 0, 1, 0)]
    assert rows(owners.files_of(broken)) == [("@a", "d/a"), ("@a", "d/c"), ("@b", "d/b")]


def test_routes(spark):
    data = [("https://github.com/o/r",), ("https://github.com/o/r/blob/main/a/b.md#x",), ("https://github.com/o/gone",), ("https://x.example/y",), (None,), ("https://github.com/o/new/blob/old/q.md",)]
    urls = spark.createDataFrame(data, "url string")
    got = {r.url: r.r.route for r in urls.where("url is not null").select("url", links.route(urls.url).alias("r")).collect()}
    assert [got[u] for (u,) in data if u] == ["repository", "repository_file", "repository", "request", "repository_file"]
    answers = spark.createDataFrame([("o", "r", None, None, 200, None, "main"), ("o", "r", "main", "a/b.md", 200, 404, "main"), ("o", "gone", None, None, 404, None, None), ("o", "new", "old", "q.md", 200, 404, "trunk")], "owner string, repo string, branch string, path string, repo_code int, file_code int, default_branch string")
    out = {r.url: (r.status, r.status_code, r.suggestion) for r in links.repository_results(urls, answers).collect()}
    assert out == {
        "https://github.com/o/r": ("ok", 200, None), "https://github.com/o/r/blob/main/a/b.md#x": ("broken", 404, None), "https://github.com/o/gone": ("broken", 404, None),
        "https://github.com/o/new/blob/old/q.md": ("broken", 404, "Try branch trunk"),
    }
    assert {r.status for r in links.repository_results(urls, answers.limit(0)).collect()} == {"error"}


def test_embedding_hits(spark):
    cache = spark.createDataFrame([("a", "1"), ("b", "1"), ("gone", "1"), ("n", None)], "path string, cached_hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "3"), ("new", "1")], "path string, content_hash string")
    assert rows(caches.embedding_hits(cache, now)) == [("a", True), ("b", False), ("gone", True), ("n", False)]


def test_related_is_never_negative(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<double>")
    b = spark.createDataFrame([(1, [1.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "id int, embedding array<double>")
    assert rows(semantic.related(a, b, 5), "id", "rank") == [(1, 1), (3, 2)]


def test_shingles_find_what_copies_share(spark):
    body = "\n".join(f"    total_{i} = compute_value({i}) + previous_total" for i in range(12))
    blocks = spark.createDataFrame([(1, "d", "python", body, None, []), (2, "d", "python", body.replace("previous", "earlier"), None, []), (3, "d", "python", "import os\n", None, []), (4, "d", None, body, None, [])], "code_id long, doc_path string, language string, code string, file_hint string, symbols array<string>")
    source = spark.createDataFrame([(10, "s/a.py", 0, "f", 1, body + "\n    return total_0\n"), (11, "s/b.py", 0, "g", 1, "def g():\n    pass\n")], "symbol_id long, file_path string, ord int, name string, start_line int, code string")
    fast, exact = ({r.code_id: (r.symbol_id, round(r.similarity, 9)) for r in snippets.matches(blocks, source, how).where("similarity >= 0.5").collect()} for how in ("shingles", True))
    assert fast == exact and set(fast) == {1, 2}


def test_snippets_by_vectors(spark):
    blocks = spark.createDataFrame([(1, "d", "python", "a = 1\n", None, []), (2, "d", "python", "b = 2\n", None, [])], "code_id long, doc_path string, language string, code string, file_hint string, symbols array<string>")
    source = spark.createDataFrame([(10, "s/a.py", 0, "f", 1, "def zz():\n    return 5\n")], "symbol_id long, file_path string, ord int, name string, start_line int, code string")
    vectors = (spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "code_id long, embedding array<float>"), spark.createDataFrame([(10, [0.9, 0.1])], "symbol_id long, embedding array<float>"))
    got = {r.code_id: (r.symbol_id, r.strategy) for r in snippets.matches(blocks, source, False, vectors).collect()}
    assert got == {1: (10, "embedding")}


def test_write_files(spark, tmp_path):
    from folioscope.sources import markdown

    (tmp_path / "a.md").write_text("old")
    df = spark.createDataFrame([(str(tmp_path / "a.md"), "new\r\n"), (str(tmp_path / "no" / "b.md"), "x"), (str(tmp_path / "c.md"), None)], "doc_path string, content string")
    assert sorted(r.written for r in markdown.write_files(df).collect()) == [False, False, True]
    assert (tmp_path / "a.md").read_bytes() == b"new\r\n" and markdown.list_files(str(tmp_path / "a.md")) == [str(tmp_path / "a.md")]


def test_scan_routes_repositories(spark, tmp_path):
    from folioscope import engine

    docs = spark.createDataFrame([("r/a.md", "r", "[x](https://github.com/o/r/blob/old/q.md) [y](https://github.com/o/r) [z](https://z.example)\n")], "doc_path string, base_path string, content string")
    answers = spark.createDataFrame([("o", "r", "old", "q.md", 200, 404, "main"), ("o", "r", None, None, 200, None, "main")], "owner string, repo string, branch string, path string, repo_code int, file_code int, default_branch string")
    done = engine.scan(docs, docs.selectExpr("doc_path as path"), repositories=answers)
    assert {r.text: (r.status, r.suggestion) for r in done.collect()} == {"x": ("broken", "Try branch main"), "y": ("ok", None), "z": ("error", None)}
    engine.report(done, "* @a\n", f"file:{tmp_path}/out")
    assert spark.read.text(f"file:{tmp_path}/out").count() > 0


def test_spread_join_and_once(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, i int")
    side = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    for how in ("left", "inner"):
        assert rows(spread_join(big, side, ["k"], how), "k", "i", "v") == rows(big.join(side, "k", how), "k", "i", "v")
    assert spread_join(big.limit(0), side, ["k"]).count() == 0 and spread_join(big, side.limit(0), ["k"], "inner").count() == 0
    assert rows(once(spark.createDataFrame([(1, "b", None), (1, "a", "z"), (2, None, None)], "id int, x string, y string"), ["id"])) == [(1, "a", "z"), (2, None, None)]
