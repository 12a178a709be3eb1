import pytest

from folioscope import config


def test_settings(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert config.load() == config.settings() == config.DEFAULTS
    (tmp_path / "c.yaml").write_text("links:\n  timeout: 3\n  nonsense: 1\nother: 1\n")
    with pytest.warns(UserWarning, match="other"):
        assert config.load("c.yaml")["links"] == {"timeout": 3, "concurrency": 20, "ignore_patterns": []}
    for bad in ({"links": {"timeout": 0}}, {"links": {"ignore_patterns": "x"}}, {"cache": {"ttl_hours": "1"}}, {"output": {"colors": "red"}}, {"links": {"concurrency": True}}):
        with pytest.raises(config.InvalidSettings):
            config.settings(bad)
    with pytest.raises(FileNotFoundError):
        config.load("none.yaml")
    (tmp_path / "bad.yaml").write_text("a: [")
    with pytest.raises(ValueError):
        config.load("bad.yaml")


def test_places(tmp_path):
    assert config.owners_file(tmp_path) is None and config.directory(tmp_path, config.DOC_DIRECTORIES) == tmp_path
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/CODEOWNERS").write_text("")
    assert config.owners_file(tmp_path) == tmp_path / "docs/CODEOWNERS" and config.directory(tmp_path, config.DOC_DIRECTORIES).name == "docs"


def test_symbols(spark):
    from folioscope.operators import symbols

    df = spark.createDataFrame([("reader", "class", "a.py", "python"), ("read", "method", "a.py", "python"), (None, None, "b.py", None)], "name string, type string, file_path string, language string")
    assert symbols.named(df, "read").count() == 1 and symbols.named(df, "read", "class").count() == 0
    assert symbols.prefixed(df, "read").count() == 2 and symbols.prefixed(df, "read", "class").count() == 1
    assert {tuple(r) for r in symbols.counts(df).collect()} == {("python", "class", 1, 1), ("python", "method", 1, 1), (None, None, 1, 1)}
    files = spark.createDataFrame([("a/x.md",), (".github/x.md",), ("x.mdx",), ("a/x.py",), ("a/dist/x.py",), ("x.rb",)], "path string")
    assert [r.path for r in symbols.embedded_docs(files).collect()] == ["a/x.md"]
    assert [r.path for r in symbols.embedded_code(files).collect()] == ["a/x.py"]
