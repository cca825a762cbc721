"""Commands over a small tree: output and exit codes."""

import json

from symloom import cli


def test_commands(spark, tmp_path):
    (tmp_path / "app.py").write_text("class A:\n    pass\n\ndef run(a):\n    return helper(a)\n")
    (tmp_path / "lib.py").write_text("def helper(a):\n    return a\n")

    def call(*argv):
        return cli.run(cli.parser().parse_args(["--root", str(tmp_path), *argv]), spark)

    assert call("index") == (0, "3 entities, 1 references")
    assert "run" in call("callers", "helper")[1] and "near names: helper" in call("callers", "helpr")[1]
    assert [r["name"] for r in json.loads(cli.run(cli.parser().parse_args(["--root", str(tmp_path), "--json", "symbols", "app.py"]), spark)[1])] == ["A", "run"]
    assert call("query", "select count(*) n from entities")[1].splitlines()[-1] == "| 3 |"
    assert call("blast", "nope")[0] == 2 and call("context", "nope")[0] == 2 and call("diff", "x..y")[0] == 3
    assert call("where", "helper")[1].count("lib.py") == 1 and call("search", "help")[0] == 0
    args = cli.parser().parse_args(["search", "x"])
    assert (args.scope, args.limit) == ("symbol", 20)


def test_reports(spark, tmp_path, monkeypatch):
    import subprocess

    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    def call(*argv):
        return cli.run(cli.parser().parse_args(["--root", str(tmp_path), *argv]), spark)

    git("init", "-q")
    body = "".join(f"    x{i} = {i}\n" for i in range(4))
    (tmp_path / "app.py").write_text(f"def process_payment(a):\n    return helper(a) + 1\n\ndef total(x):\n{body}    return x\n")
    (tmp_path / "lib.py").write_text(f"def helper(a):\n    return a\n\ndef same(x):\n{body}    return x\n")
    (tmp_path / "use.py").write_text("def main():\n    return process_payment(helper(2))\n")
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "app.py").write_text(f"def execute_payment(a, b):\n    return helper(a) + 1\n\ndef total(x):\n{body}    return  x\n\ndef audit():\n    return 2\n")
    (tmp_path / "lib.py").write_text(f"def helper(a, b):\n    return a\n\ndef same(x):\n{body}    return x\n")
    git("add", "."), git("commit", "-qm", "two")
    monkeypatch.setenv("SYMLOOM_AUTO_INDEX", "0")
    try:
        call("where", "helper")
        raise AssertionError
    except ValueError as error:
        assert "isn't indexed" in str(error)
    monkeypatch.delenv("SYMLOOM_AUTO_INDEX")
    call("index")
    d = json.loads(call("--json", "diff", "HEAD~1", "--group")[1])
    assert d["meta"] == {"base_ref": "HEAD~1", "head_ref": "HEAD"} and {k: d["summary"][k] for k in ("added", "modified", "renamed", "formatting_only", "breaking", "has_breaking", "files_changed")} == {"added": 1, "modified": 1, "renamed": 1, "formatting_only": 1, "breaking": 2, "has_breaking": True, "files_changed": 2}
    assert d["summary"]["natural_language"] == "1 added, 1 modified, 1 renamed, 1 formatting only with breaking changes."
    assert [(b["name"], b["callers_in_diff"], [(x["file"], x["line"], x["name"]) for x in b["external"]]) for b in sorted(d["breaking"], key=lambda b: b["name"])] == [("execute_payment", 0, []), ("helper", 1, [("use.py", 2, "main")])]
    assert [f["file"] for f in d["files"]] == ["app.py", "lib.py"] and d["groups"][0]["label"] == "execute_payment, audit in app.py"
    assert any(e["token_changes"] for f in d["files"] for e in f["entities"])
    page = call("--markdown", "diff", "HEAD~1", "--lines")[1]
    assert page.startswith("**diff** `HEAD~1`: 2 files, **2 breaking**") and "\n---\n" in page and "- ~ `helper` _function_ :1 **breaking**: public signature changed" in page and "```diff" in page and "use.py:2" in page
    text = call("diff", "HEAD~1", "--lines", "--no-color", "--no-callers")[1]
    assert "> function execute_payment:1 (was process_payment)  BREAKING" in text and "\033" not in text and text == call("diff", "HEAD~1", "--lines", "--no-color", "--no-callers")[1]
    assert call("diff", "HEAD..HEAD")[1] == "No structural changes." and "no structural changes" in call("--markdown", "diff", "HEAD..HEAD")[1]
    (tmp_path / "old.py").write_text("def a():\n    return 1\n")
    (tmp_path / "new.py").write_text("def a():\n    return 2\n")
    two = json.loads(call("--json", "files", str(tmp_path / "old.py"), str(tmp_path / "new.py"))[1])
    assert [(f["file"], f["modified"]) for f in two["files"]] == [(str(tmp_path / "new.py"), 1)] and call("files", str(tmp_path / "old.py"), "x.rs")[0] == 3
    assert call("blast", "helper")[1].startswith("# `helper`\n\n**function** in `lib.py`:1-2") and "## Callers (2 of 2)" in call("blast", "helper")[1]
    assert "## Callers" in call("context", "helper")[1] and json.loads(call("--json", "context", "helper")[1])["chosen"]["file"] == "lib.py"
    assert call("where", "helper")[1].startswith("1 definition\nlib.py:1  function helper") and "  1-2  function helper" in call("outline")[1]
    found = call("duplicates")[1]
    assert found.startswith("1 group of equal bodies, 2 members, 6 entities") and "lib.py:4-9  function same" in found
    page = call("review", "HEAD~1")[1]
    assert page.startswith("# Review of `HEAD~1`\n\n4 entities changed") and "## Most impact" in page and "## Breaking" in page
    rows = json.loads(call("--json", "benchmark")[1])
    assert [r["name"] for r in rows["queries"]] == ["review of HEAD~1", "context of helper", "overview"] and rows["median_ratio"] > 0 and "median ratio" in call("benchmark", "--spec", "nope")[1] and "skipped" in call("benchmark", "--spec", "nope")[1]
    path = call("map", "--write")[1]
    assert open(path).read().startswith("# Map")
