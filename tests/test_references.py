from datetime import datetime as T

import pytest

from folioscope.operators import references as R

LINKS = "link_id long, repo string, doc_path string, url string, status string, checked_ts timestamp"
PAGES = "doc_path string, headings array<struct<level:int,text:string,line:int>>, added_ts timestamp, deleted_ts timestamp"


def h(*texts):
    return [(1, t, 1) for t in texts]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(
        [
            ("r/a.md", h("Intro", "Intro", "Zwei: Über"), T(2025, 1, 1), None),
            ("r/docs/b.md", h(), T(2025, 1, 1), T(2025, 3, 1)),
            ("r/docs/b.md", h("Back"), T(2025, 6, 1), None),
            ("r/docs/b.md", h("Back"), T(2025, 6, 1), None),
            ("r/x", h("Plain"), T(2025, 1, 1), None),
            ("r/x.md", h("Dotted"), T(2025, 1, 1), None),
            ("r/none.md", None, T(2025, 1, 1), None),
            (None, h("N"), T(2025, 1, 1), None),
        ],
        PAGES,
    )


CASES = [
    (1, "docs/b.md", T(2025, 2, 1), None),
    (2, "docs/b.md", T(2025, 3, 1), "page"),
    (3, "./docs/../docs/b", T(2025, 6, 1), None),
    (4, "docs/b.md#back", T(2025, 7, 1), None),
    (5, "docs/b.md#Back", T(2025, 7, 1), "anchor"),
    (6, "#intro-1", T(2025, 7, 1), None),
    (7, "#intro-2", T(2025, 7, 1), "anchor"),
    (8, "#zwei-über", T(2025, 7, 1), None),
    (9, "https://a.example/x", T(2025, 7, 1), None),
    (10, "img/a.png", T(2025, 7, 1), None),
    (11, "", T(2025, 7, 1), None),
    (12, None, T(2025, 7, 1), None),
    (13, "x#plain", T(2025, 7, 1), None),
    (14, "x#dotted", T(2025, 7, 1), "anchor"),
    (15, "/docs/b.md", T(2025, 7, 1), None),
    (16, "../../r/a.md", T(2025, 7, 1), "page"),
    (17, "none#any", T(2025, 7, 1), "anchor"),
    (18, "#", T(2025, 7, 1), None),
    (19, "a.md", None, "page"),
    (20, "docs/b.mdx", T(2025, 7, 1), "page"),
]


def test_link_orphans(spark, pages):
    rows = [(i, "r", "r/a.md", u, None, t) for i, u, t, _ in CASES]
    links = spark.createDataFrame(rows + rows[:3], LINKS)
    got = {r.link_id: r.reason for r in R.link_orphans(links, pages).collect()}
    assert got == {i: w for i, _, _, w in CASES if w}
    report = R.link_orphan_report(links, pages).groupBy().sum("n_links", "n_orphans", "n_unclaimed").first()
    assert list(report) == [16, len(got), len(got)]


def test_hot_target(spark, pages):
    rows = [(i, "r", "r/a.md", "docs/b.md#gone" if i % 3 else "docs/b.md", "ok", T(2025, 7, 1)) for i in range(900)]
    assert R.link_orphans(spark.createDataFrame(rows, LINKS), pages).count() == 600


def test_empty(spark, pages):
    none = spark.createDataFrame([], LINKS)
    assert R.link_orphans(none, pages).count() == 0
    one = spark.createDataFrame([(1, "r", "r/a.md", "b", None, T(2025, 1, 1))], LINKS)
    assert R.link_orphans(one, spark.createDataFrame([], PAGES)).count() == 1


def test_orphans(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "b", "x"), (4, "b", "x")], "id long, key string, __k0 string")
    parents = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "key string, id int")
    lost = R.orphans(rows, ["key"], parents, ["key"])
    assert sorted(r.id for r in lost.collect()) == [2, 4, 4]
    assert lost.columns == rows.columns
    assert R.orphans(rows, ["key"], parents.limit(0), ["key"]).count() == 4
