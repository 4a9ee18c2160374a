from __future__ import annotations

import os

import pytest
from helpers import rows

from envtally import scan
from envtally.sources.tree import load_env_files, load_tree


@pytest.fixture
def tree(tmp_path):
    texts = {
        "app/_q.js": b"process.env.Q", "app/.hid/y.js": b"process.env.Y\r\n", "app/.git/z.js": b"", "app/B.JS": b"",
        "app/node_modules/k/z.js": b"", "app/sub/deep/m.py": b'os.getenv("P") \xff\xfe', "app/sub/readme.md": b"",
        "app/Dockerfile.prod": b"FROM x\nENV D=1\n", "app/tmp/t.go": b"", "app/empty/.keep": b"", "app/sub/tmp": b"",
        "vendor/v.js": b"process.env.V", "app/.env": b"Q=1\n", "app/vendor.js": b"",
    }
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text)
    os.symlink(tmp_path / "app/_q.js", tmp_path / "app/link.js")
    os.symlink(tmp_path / "app/sub", tmp_path / "app/linked")
    return tmp_path


def test_load_tree(spark, tree):
    roots = {"p": f"{tree}/app/", "ignored": f"{tree}/vendor", "link": f"{tree}/app/linked"}
    files = load_tree(spark, roots, ignore=" tmp ")
    names = [".hid/y.js", "Dockerfile.prod", "_q.js", "sub/deep/m.py", "vendor.js"]
    assert rows(files, "project", "path") == [("p", f"{tree}/app/{name}") for name in names]
    sizes = {r.path.rsplit("/", 1)[1]: r.n for r in files.selectExpr("path", "octet_length(content) AS n").collect()}
    assert sizes["m.py"] == 17  # bytes that are no UTF-8 are kept


def test_a_bad_root_beside_a_good_one(spark, tree):
    roots = [("p", f"{tree}/app"), ("gone", f"{tree}/none"), ("file", f"{tree}/app/.env"), ("relative", "app")]
    files = load_tree(spark, spark.createDataFrame(roots, "project string, root string"))
    names = spark.createDataFrame([(p, 0, f"{tree}/app/.env") for p, _ in roots], "project string, ordinal int, env_path string")
    result = scan(files, load_env_files(spark, names))
    for scanned in (result, result.pinned()):
        assert rows(scanned.gate) == [("file", 2), ("gone", 2), ("p", 1), ("relative", 2)]
        assert {r[0] for r in rows(scanned.findings, "project")} == {"p"}
        assert rows(scanned.summary, "project") == [("p",)]
        assert rows(scanned.warnings, "project", "path", "stage", "reason") == [
            ("file", f"{tree}/app/.env", "walk", "unlistable"), ("gone", f"{tree}/none", "walk", "unlistable"),
            ("relative", "app", "walk", "unlistable"),
        ]


def test_a_directory_that_cannot_be_listed_fails_its_project_only(spark, tree, monkeypatch):
    from envtally.sources import tree as module

    original = module._entries

    def entries(directory, ignored):
        if directory.endswith(b"/deep"):
            raise PermissionError(directory)
        yield from original(directory, ignored)

    found = []
    monkeypatch.setattr(module, "_entries", entries)
    for list_ in (module._listing([], True), module._listing([], False)):
        import pandas as pd

        batch = pd.DataFrame([("p", "", f"{tree}/app/sub/deep".encode()), ("q", "", f"{tree}/app/sub".encode())], columns=["project", "root", "path"])
        found.append(pd.concat(list_(iter([batch]))).set_index("project"))
    for frame in found:
        assert frame.loc["p"].unlistable and not frame.loc[["q"]].unlistable.any()


def test_a_link_with_a_slash_is_followed(spark, tree):
    linked = load_tree(spark, {"p": f"{tree}/app/linked/"})
    assert rows(linked, "root", "path") == [(f"{tree}/app/linked", f"{tree}/app/linked/deep/m.py")]


def test_relative_roots(spark, tree):
    with pytest.raises(ValueError, match="absolute"):
        load_tree(spark, {"p": "app"})
    assert load_tree(spark, {"p": f"{tree}/./app/../app/sub"}).select("root").first()[0] == f"{tree}/app/sub"


def test_an_audit_of_a_tree(spark, tree):
    files = load_tree(spark, {"p": f"{tree}/app"})
    env = load_env_files(spark, {"p": [f"{tree}/app/.env", f"{tree}/app/.env.gone"]})
    result = scan(files, env)
    assert rows(result.findings, "rule_id", "variable", "path", "line_no") == [
        ("ENV002", "P", f"{tree}/app/sub/deep/m.py", 1), ("ENV002", "Y", f"{tree}/app/.hid/y.js", 1),
        ("ENV003", "P", f"{tree}/app/sub/deep/m.py", 1), ("ENV003", "Y", f"{tree}/app/.hid/y.js", 1),
        ("ENV004", "D", None, None),
    ]
    assert rows(result.warnings, "path", "reason") == [(f"{tree}/app/.env.gone", "unreadable")]


def test_unreadable_files_are_warned_about(spark, tree):
    files = load_tree(spark, {"p": f"{tree}/app"})
    os.remove(tree / "app/_q.js")  # listed, gone when it is read
    result = scan(files, load_env_files(spark, {"p": [f"{tree}/app/.env"]}))
    assert rows(result.warnings, "path", "stage", "reason") == [(f"{tree}/app/_q.js", "source", "unreadable")]
    assert result.summary.first()["files_scanned"] == 6


def test_env_files_keep_their_order(spark, tree):
    (tree / "b.env").write_text("Q=2")
    env = load_env_files(spark, {"p": [f"{tree}/b.env", f"{tree}/app/.env"]})
    assert rows(env, "ordinal", "env_path", "content") == [(0, f"{tree}/b.env", "Q=2"), (1, f"{tree}/app/.env", "Q=1\n")]


def test_relative_env_paths(spark, tree):
    with pytest.raises(ValueError, match="absolute"):
        load_env_files(spark, {"p": [f"{tree}/app/.env", "app/.env"]})
    names = spark.createDataFrame([("p", 0, "app/.env"), ("q", 0, f"{tree}/app/.env")], "project string, ordinal int, env_path string")
    env = load_env_files(spark, names)
    assert rows(env, "project", "content") == [("p", None), ("q", "Q=1\n")]
    before = os.getcwd()
    os.chdir(tree)  # even where the path would be found
    try:
        result = scan(load_tree(spark, {"p": f"{tree}/app", "q": f"{tree}/app"}), load_env_files(spark, names))
        assert rows(result.gate) == [("p", 2), ("q", 1)]
        assert rows(result.warnings) == [("p", "app/.env", "env", "unreadable")]
    finally:
        os.chdir(before)


def test_a_size_limit_at_load(spark, tree):
    """A file above the limit has no text and causes a warning; one of just that size is read."""
    size = len(b"process.env.Y\r\n")
    files = load_tree(spark, {"p": f"{tree}/app"}, max_file_bytes=size)
    env = load_env_files(spark, {"p": [f"{tree}/app/.env"]}, max_file_bytes=size)
    result = scan(files, env)
    assert rows(result.warnings, "path", "stage", "reason") == [(f"{tree}/app/sub/deep/m.py", "source", "unreadable")]
    assert ("ENV002", "Y") in rows(result.findings, "rule_id", "variable")
    assert rows(load_env_files(spark, {"p": [f"{tree}/app/.env"]}, max_file_bytes=3), "content") == [(None,)]
