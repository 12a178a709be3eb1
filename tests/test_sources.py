from datetime import datetime as T

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioscope import engine
from folioscope.operators import semantic
from folioscope.sources import caches, code, markdown
from folioscope.sources.store import KeyedTable
from folioscope.streaming import caches as streams

PAGE = """# One *two*

See [a](b.md) and ![pic](i.png "t"), [full][Lab], [lab], [undefined] and `[no](x)`.
More \\[no](y) <https://auto.example> [**bold** text](z.md).

Title
-----

> ```python
> x = 1
> ```

- item [in list](l.md)
  ~~~
  y
  ~~~

    [indented](no.md)

[lab]: http://one.example
[lab]: http://two.example
"""


def test_parse():
    got = markdown.parse(PAGE)
    assert [(x["url"], x["is_image"]) for x in got["links"]] == [
        ("b.md", False), ("i.png", True), ("http://two.example", False), ("http://two.example", False), ("https://auto.example", False), ("z.md", False), ("l.md", False)
    ]
    assert [(h["level"], h["text"], h["line"]) for h in got["headings"]] == [(1, "One *two*", 1), (2, "Title", 6)]
    assert [(b["language"], b["code"], b["line"]) for b in got["blocks"]] == [("python", "x = 1\n", 9), ("", "y\n", 14)]
    assert got["references"] == [{"label": "lab", "url": "http://two.example"}]
    assert markdown.parse("") == {"links": [], "headings": [], "blocks": [], "references": []}


def test_scan(spark):
    docs = spark.createDataFrame([("d", "b", PAGE), ("e", "b", None), ("f", "b", "")], "doc_path string, base_path string, content string")
    s = markdown.scan(docs)
    assert markdown.links(s).count() == 7 and markdown.headings(s).count() == 2 and markdown.references(s).count() == 1
    assert rows(markdown.code_blocks(s), "language", "file_hint") == [("", None), ("python", None)]


def test_hints_and_symbols(spark):
    df = spark.createDataFrame([("// src/A.java\nclass A {}", "java"), ("# File: b.py\ndef f(): pass\nclass C: pass", "python"), ("x", "go"), ("func (r *T) Go() {}\ntype Q struct {", "go"), ("const a = async (x) => 1", "ts")], "code string, language string")
    got = [(r.h, r.s) for r in df.select(markdown.file_hint(F.col("code")).alias("h"), markdown.snippet_symbols(F.col("code"), F.col("language")).alias("s")).collect()]
    assert got == [("src/A.java", ["A"]), ("b.py", ["C", "f"]), (None, []), (None, ["Go", "Q"]), (None, ["a"])]


def test_files(spark, tmp_path):
    for name, data in [("a.md", b"# A"), (".hidden/b.mdx", b"x"), ("sub/c.txt", b"no"), ("sub/d.md", b"\xff")]:
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    found = markdown.list_files(str(tmp_path))
    assert [f[len(str(tmp_path)) + 1 :] for f in found] == [".hidden/b.mdx", "a.md", "sub/d.md"]
    assert markdown.read_files(spark, found, str(tmp_path)).count() == 2


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a.py", "class A:\n    def m(self):\n        pass\n    @x\n    def n(self): pass\ndef f():\n    pass\n", [("A", "class", 1, 5), ("m", "method", 2, 3), ("n", "function", 5, 5), ("f", "function", 6, 7)]),
        ("a.py", "def f(:\n    x\n", [("f", "function", 1, 2)]),
        ("a.go", "package p\n\ntype T struct {\n\tx int\n}\n\nfunc (t T) M() {\n}\nfunc F() {}\n", [("T", "type", 3, 5), ("M", "method", 7, 8), ("F", "function", 9, 9)]),
        ("a.rs", "pub struct S {\n a: u8,\n}\nimpl S { fn f() { \"}\"; } }\nenum E { A }", [("S", "struct", 1, 3), ("f", "function", 4, 4), ("E", "enum", 5, 5)]),
        ("a.ts", "interface I { a: b }\nclass C {\n}\nfunction f() {}", [("I", "interface", 1, 1), ("C", "class", 2, 3), ("f", "function", 4, 4)]),
        ("a.scala", "object O {\n  def f(x: Int) = {\n    1\n  }\n}\ntrait T", [("O", "object", 1, 5), ("f", "function", 2, 4), ("T", "trait", 6, 6)]),
        ("x.bzl", "def m(a):\n    pass\n", [("m", "function", 1, 2)]),
    ],
)
def test_extract(path, text, want):
    got = code.extract(text, code.LANGUAGES["." + path.split(".")[1]])
    assert [(s["name"], s["type"], s["start_line"], s["end_line"]) for s in got] == want


def test_symbols(spark):
    files = spark.createDataFrame([("s/a.py", "def f(): pass"), ("s/node_modules/a.py", "def g(): pass"), ("s/a.txt", "x"), ("s/b.PY", None)], "file_path string, content string")
    assert rows(code.symbols(files), "file_path", "name", "language") == [("s/a.py", "f", "python")]


def test_caches(spark):
    kind = "url string, status string, status_code int, error string, ts timestamp, response_time double"
    cache = spark.createDataFrame([("a", "ok", 200, None, T(2025, 1, 1), 0.5), ("b", "broken", 404, None, T(2025, 1, 2), 1.5), ("c", "broken", 500, None, T(2025, 1, 3), None), ("d", "ok", 200, None, None, None)], kind)
    now = F.lit("2025-01-03 00:00:00").cast("timestamp")
    keys = spark.createDataFrame([("b",), ("c",), ("c",), (None,), ("zz",)], "url string")
    assert rows(caches.lookup(cache, keys, now, 24), "url") == [("c",)]
    stay, gone = caches.expired(cache, now, 24)
    assert rows(gone, "url") == [("a",)] and stay.count() == 3
    assert rows(caches.statistics(cache, now, 24)) == [(4, 1, 3, 2, 2, 1000.0)]
    assert rows(caches.statistics(cache.limit(0), now, 24)) == [(0, 0, 0, 0, 0, 0.0)]
    batch = spark.createDataFrame([("a", "x", 1, None, T(2025, 2, 1), 0.0, 1), ("a", "y", 2, None, T(2025, 2, 1), 0.0, 2), ("n", "z", 3, None, None, 0.0, 3)], kind + ", ord int")
    assert rows(caches.upsert(cache, batch, ["url"]), "url", "status") == [("a", "y"), ("b", "broken"), ("c", "broken"), ("d", "ok"), ("n", "z")]
    assert rows(caches.newest_broken(cache, now, 48, 1), "url") == [("c",)]


def test_streams(spark, tmp_path):
    kind = "url string, status string, ts timestamp"
    for i, data in enumerate([[("a", "x", T(2025, 1, 1)), ("b", "x", T(2025, 1, 1))], [("a", "y", T(2025, 1, 2)), (None, "q", T(2025, 1, 2))], [("a", "old", T(2024, 1, 1))]]):
        spark.createDataFrame(data, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*"))
        table = KeyedTable(spark, f"file:{tmp_path}/out", ["url"], ["ts"], 4)
        streams.upsert_stream(source.where("url is not null"), table, str(tmp_path / "ck")).awaitTermination()
        assert table.read().count() == 2
    assert rows(table.read(), "url", "status") == [("a", "y"), ("b", "x")]
    q = streams.latest_by_key(spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*")), "url").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("latest"), "url", "status") == [("a", "y"), ("b", "x")]


def test_store(spark, tmp_path):
    t = KeyedTable(spark, f"file:{tmp_path}/t", ["k"], ["n"], 8)
    frame = lambda data: spark.createDataFrame(data, "k string, n int, v string")
    assert not t.exists()
    t.upsert(frame([]))
    assert t.read().count() == 0
    t.upsert(frame([(f"k{i}", 1, "a") for i in range(40)] + [(None, 1, "x"), ("k1", 0, "older")]))
    t.upsert(frame([("k1", 2, "b"), ("k2", 0, "late"), ("new", None, None)]))
    assert rows(t.get(spark.createDataFrame([("k1",), ("k2",), ("new",), ("no",), (None,)], "k string"))) == [("k1", 2, "b"), ("k2", 1, "a"), ("new", None, None)]
    t.delete(spark.createDataFrame([("k3",), ("no",)], "k string"))
    assert t.read().count() == 40
    assert t.upsert(frame([("k3", 5, "c")]), 7) and not t.upsert(frame([("k3", 6, "d")]), 7)
    assert rows(t.get(spark.createDataFrame([("k3",)], "k string"))) == [("k3", 5, "c")]
    # a write that dies before it publishes leaves the table as it was
    publish, t._publish = t._publish, None
    with pytest.raises(TypeError):
        t.upsert(frame([("k3", 9, "lost")]))
    t._publish = publish
    assert t.read().where("v = 'lost'").count() == 0 and t.read().count() == 41
    t.clear()
    assert t.read().count() == 0
    assert len(list((tmp_path / "t" / "_manifests").glob("*.json"))) <= 2
    # equal keys of another integer type fall into the same bucket
    n = KeyedTable(spark, f"file:{tmp_path}/n", ["id"], buckets=16)
    n.upsert(spark.createDataFrame([(i, i) for i in range(30)], "id long, x int"))
    n.upsert(spark.createDataFrame([(3, -1)], "id int, x int"))
    assert n.read().count() == 30 and n.get(spark.createDataFrame([(3,)], "id int")).first().x == -1


def test_reindex_stream(spark, tmp_path):
    kind = "path string, content string"
    index = KeyedTable(spark, f"file:{tmp_path}/index", ["path"])
    made = []

    def make(changed):
        made.append({r.path for r in changed.collect()})
        return changed.select("path", "content_hash")

    for i, data in enumerate([[("a", "1"), ("b", "1"), ("n", None)], [("a", "1"), ("b", "2")], [("b", "2")]]):
        spark.createDataFrame(data, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*"))
        streams.reindex_stream(source, index, make, str(tmp_path / "ck")).awaitTermination()
    assert made == [{"a", "b"}, {"b"}, set()] and index.read().count() == 2


def test_fractional_ttl(spark):
    """An entry outlives a life of 0.0001 hours (0.36 s) by no more than that."""
    from datetime import timedelta

    at = T(2025, 1, 1)
    cache = spark.createDataFrame([("a", at), ("b", at - timedelta(milliseconds=350)), ("c", at - timedelta(milliseconds=370))], "url string, ts timestamp")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    assert rows(caches.lookup(cache, cache, now, 0.0001), "url") == [("a",), ("b",)]
    half = spark.createDataFrame([("x", at - timedelta(minutes=10)), ("y", at - timedelta(minutes=31))], "url string, ts timestamp")
    assert rows(caches.lookup(half, half, now, 0.5), "url") == [("x",)]
    assert [df.count() for df in caches.expired(half, now, 0.5)] == [1, 1]


def test_skipped_directories(spark):
    files = spark.createDataFrame([(p,) for p in ("a/.eggs/x.py", "a/site-packages/x.py", ".ruff_cache/x.py", "vendor/x.go", "third_party/x.rs", "a/.env/x.py", "a/node_modules/b/x.js", "x.txt", "src/X.PY")], "file_path string")
    assert {r.file_path for r in code.indexable(files).collect()} == {"vendor/x.go", "third_party/x.rs", "a/.env/x.py", "src/X.PY"}


def test_chunks(spark):
    def plain(text, size):
        out, cur, n = [], [], 0
        for p in text.split("\n\n"):
            if n + len(p) > size and cur:
                out.append("\n\n".join(cur))
                cur, n = [], 0
            cur.append(p)
            n += len(p)
        return [*out, "\n\n".join(cur)]

    texts = ["", "a", "\n\nb" * 9, "x" * 50 + "\n\n" + "y" * 3 + "\n\n" + "z" * 3]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r.c for r in df.select(semantic.greedy_chunks(F.col("t"), 6).alias("c")).collect()]
    assert got == [*[plain(t, 6) for t in texts], None]


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    q, c = rng.standard_normal((30, 8)), rng.standard_normal((50, 8))
    c[7] = 0
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0])], "id int, embedding array<double>")
    got = {(r.query_id, r.id) for r in semantic.nearest(frame(q), frame(c), 3, 0.2).where("query_id < 1000").collect()}
    s = (q @ c.T) / np.maximum(np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)), 1e-12)
    want = {(i, int(j)) for i in range(30) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.2}
    assert got == want
    few = semantic.orphans(frame(q), frame(c), 0.5).where("id < 1000")
    assert {r.id for r in few.collect()} == {i for i in range(30) if s[i].max() < 0.5}
    assert semantic.orphans(frame(q), frame(c).limit(0), 0.5).count() == 0
    e = semantic.embed(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "id int, text string"))
    v = {r.id: r.embedding for r in e.collect()}
    assert v[1] == v[2] and not any(v[3]) and len(v[4]) == 64


def test_engine(spark):
    docs = spark.createDataFrame([("r/a.md", "r", "# Top\n[b](b.md) [c](c) [t](#topp) [x](https://x.example) [y](https://y.example) [m](mailto:q) [i](http://localhost/)\n"), ("r/b.md", "r", "none")], "doc_path string, base_path string, content string")
    files = docs.select(F.col("doc_path").alias("path"))
    probes = spark.createDataFrame([("https://y.example", 1, 404, None)], "url string, attempt int, status_code int, error string")
    cache = spark.createDataFrame([("https://x.example", "broken", 404, None, T(2025, 1, 1), 0.1)], "url string, status string, status_code int, error string, ts timestamp, response_time double")
    got = engine.scan(docs, files, cache, F.lit("2025-01-01 01:00:00").cast("timestamp"), probes, ignore=["localhost"])
    assert {r.url: r.status for r in got.collect()} == {
        "b.md": "ok", "c": "broken", "#topp": "broken", "https://x.example": "cached", "https://y.example": "broken", "mailto:q": "skipped", "http://localhost/": "skipped"
    }
    assert {r.url: r.suggestion for r in got.where("suggestion is not null").collect()} == {"c": "Did you mean c.md?", "#topp": "Did you mean #top?"}


def test_code_chunks(spark):
    import re

    def plain(content, ending):
        out = []
        if ending == ".py":
            out = re.findall(r'(?s)"""(.*?)"""', content)
            out += [content[max(0, m.start() - 100) : m.start() + 500] for m in re.finditer(r"(?:def|class)\s+\w+[^:]*:", content)]
        elif ending == ".js":
            out = re.findall(r"(?s)/\*\*(.*?)\*/", content)
        return [c[:2000] for c in out if len(c) > 50] or [content[:5000]]

    body = '"""' + "doc " * 40 + '"""\nclass A(B):\n' + "    x = 1\n" * 30 + "    def f(self, a: int):\n" + "        pass\n" * 60 + "def g():\n    é = 2\n"
    data = [(body, ".py"), ("/** " + "x" * 90 + " */ f()", ".js"), ("short", ".py"), ("", ".go"), ("def f(", ".py"), (body * 3, ".py")]
    df = spark.createDataFrame(data, "content string, ending string")
    got = [r.c for r in df.select(semantic.code_chunks(F.col("content"), F.col("ending")).alias("c")).collect()]
    assert got == [plain(*d) for d in data]


def test_code_chunks_cover_every_symbol(spark, tiny):
    from folioscope.plans import documents

    want = {r.code_id for r in spark.read.parquet(f"{tiny}/symbols.parquet").where("code is not null").select("code_id").collect()}
    assert {r.code_id for r in documents.code_chunks(spark, tiny).select("code_id").collect()} == want
