"""Extractors on small sources: what must be found, with lines, parents and references."""

import json

import pytest

from symloom.sources import documents, extract

SOURCES = {
    "a.py": ('import os\nfrom typing import Optional\n\n@dataclass\nclass Service:\n    """Doc."""\n    LIMIT = 3\n\n    def get(self, i: int) -> Optional[dict]:\n        return self.db.find(i)\n\ndef _hidden(x):\n    return compute(x)\n', {("import", "os", None, 1, 1), ("class", "Service", None, 4, 10), ("constant", "Service.LIMIT", "Service", 7, 7), ("method", "Service.get", "Service", 9, 10), ("function", "_hidden", None, 12, 13)}, {("Service.get", "self.db.find", "call", 10), ("_hidden", "compute", "call", 13), (None, "typing.Optional", "import", 2)}),
    "a.rs": ("use std::fmt;\n\n#[derive(Clone)]\npub struct Config {\n    pub port: u16,\n}\n\nimpl Config {\n    pub fn new() -> Self {\n        helper(1)\n    }\n}\n\npub(crate) trait Run { fn go(&self); }\nconst MAX: u8 = 3;\n", {("import", "std::fmt", None, 1, 1), ("struct", "Config", None, 3, 6), ("impl", "Config", None, 8, 12), ("method", "Config.new", "Config", 9, 11), ("interface", "Run", None, 14, 14), ("constant", "MAX", None, 15, 15)}, {("Config.new", "helper", "call", 10), (None, "std::fmt", "import", 1)}),
    "a.go": ('package main\n\nimport (\n\t"fmt"\n)\n\ntype Config struct {\n\tPort int\n}\n\nfunc (c *Config) Check() error {\n\treturn fmt.Errorf("x: %d", c.Port)\n}\n\nfunc lower() {\n\thelper()\n}\n', {("module", "main", None, 1, 1), ("import", "fmt", None, 4, 4), ("struct", "Config", None, 7, 9), ("property", "Config.Port", "Config", 8, 8), ("method", "Config.Check", "Config", 11, 13), ("function", "lower", None, 15, 17)}, {("Config.Check", "fmt.Errorf", "call", 12), ("lower", "helper", "call", 16)}),
    "a.ts": ("import { R } from 'express';\n\ninterface Conf {\n    host: string;\n}\n\nclass Svc {\n    private db: Db;\n    async get(id: number): Promise<User> {\n        return this.db.find(id);\n    }\n}\n\nconst handler = async (req: R) => {\n    send(req);\n};\n\nexport function check(p: number): boolean {\n    return new Thing(p).ok;\n}\nexport type Id = string;\nenum Color { Red }\n", {("import", "express", None, 1, 1), ("interface", "Conf", None, 3, 5), ("property", "Conf.host", "Conf", 4, 4), ("class", "Svc", None, 7, 12), ("property", "Svc.db", "Svc", 8, 8), ("method", "Svc.get", "Svc", 9, 11), ("function", "handler", None, 14, 16), ("function", "check", None, 18, 20), ("type_alias", "Id", None, 21, 21), ("enum", "Color", None, 22, 22)}, {("Svc.get", "this.db.find", "call", 10), ("handler", "send", "call", 15), ("check", "Thing", "instantiation", 19)}),
    "a.js": ("import x from './x';\nexport class A {\n  #hid() {\n    go();\n  }\n}\nconst LIMIT = 3;\n", {("class", "A", None, 2, 6), ("method", "A.#hid", "A", 3, 5), ("constant", "LIMIT", None, 7, 7)}, {("A.#hid", "go", "call", 4), (None, "./x", "import", 1)}),
    "A.java": ("package a.b;\nimport java.util.Map;\npublic class Foo extends Bar {\n    private static final int MAX = 3;\n    protected String name;\n    public Foo(String n) { helper(n); }\n    @Override\n    public int get(int a) throws X {\n        return new Baz(a).run();\n    }\n}\n", {("module", "a.b", None, 1, 1), ("import", "java.util.Map", None, 2, 2), ("class", "Foo", None, 3, 11), ("constant", "Foo.MAX", "Foo", 4, 4), ("property", "Foo.name", "Foo", 5, 5), ("constructor", "Foo.Foo", "Foo", 6, 6), ("method", "Foo.get", "Foo", 7, 10)}, {("Foo.Foo", "helper", "call", 6), ("Foo.get", "Baz", "instantiation", 9)}),
    "a.c": ("#include <stdio.h>\n#define MAX 3\n#define SQ(x) ((x)*(x))\nstruct node { int a; };\nenum color { RED };\nstatic int helper(int a) {\n  return other(a);\n}\n/* int gone(void) { } */\n", {("import", "stdio.h", None, 1, 1), ("constant", "MAX", None, 2, 2), ("macro", "SQ", None, 3, 3), ("struct", "node", None, 4, 4), ("property", "node.a", "node", 4, 4), ("enum", "color", None, 5, 5), ("constant", "color.RED", "color", 5, 5), ("function", "helper", None, 6, 8)}, {("helper", "other", "call", 7)}),
    "a.cpp": ("#include <vector>\nnamespace ns {\nclass A : public B {\n public:\n  int get() const {\n    return calc(1);\n  }\n};\n}\nint ns::A::other(int a) {\n  return helper(a);\n}\n", {("module", "ns", None, 2, 9), ("class", "A", None, 3, 8), ("method", "A.get", "A", 5, 7), ("method", "A.other", "A", 10, 12)}, {("A.get", "calc", "call", 6), ("A.other", "helper", "call", 11)}),
    "a.cs": ("using System;\nnamespace App {\n  public class Svc : Base {\n    private readonly Db db;\n    public const int Max = 4;\n    public string Name { get; set; }\n    public int Run(int a) {\n      return Other(a);\n    }\n  }\n}\n", {("import", "System", None, 1, 1), ("module", "App", None, 2, 11), ("class", "Svc", None, 3, 10), ("property", "Svc.db", "Svc", 4, 4), ("constant", "Svc.Max", "Svc", 5, 5), ("property", "Svc.Name", "Svc", 6, 6), ("method", "Svc.Run", "Svc", 7, 9)}, {("Svc.Run", "Other", "call", 8)}),
    "a.rb": ("require 'json'\nmodule M\n  class A < B\n    LIMIT = 3\n    def make(x)\n      build_it(x) if x\n    end\n  end\nend\n", {("import", "json", None, 1, 1), ("module", "M", None, 2, 9), ("class", "A", None, 3, 8), ("method", "A.make", "A", 5, 7)}, {("A.make", "build_it", "call", 6)}),
    "a.vue": ("<template>\n</template>\n<script lang=\"ts\">\nexport function setup(): void {\n  load();\n}\n</script>\n", {("function", "setup", None, 4, 6)}, {("setup", "load", "call", 5)}),
    "a.astro": ("---\nconst x = load();\n---\n<p/>\n", {("variable", "x", None, 2, 2)}, {(None, "load", "call", 2)}),
}


@pytest.mark.parametrize("path", SOURCES)
def test_code(path):
    text, want, refs = SOURCES[path]
    entities, uses = extract.rows_of(path, text)
    got = {(e[2], e[1], e[5], e[3], e[4]) for e in entities}
    assert want <= got, sorted(want - got, key=str)
    have = {(r[1], r[2], r[3], r[4]) for r in uses}
    assert refs <= have, (refs - have, have)
    assert all(len(e[10]) == 16 for e in entities) and extract.rows_of(path, text) == (entities, uses)


def test_members_of_c_and_cpp():
    e = {x[1]: (x[2], x[3], x[4], x[5], x[11]) for x in extract.rows_of("a.c", "struct s {\n  int a, *b;\n  char c[3];\n  int (*f)(int);\n  struct { int z; } in;\n};\nenum e {\n  A,\n  B = 3,\n  C\n};\n#define F(x) go(x)\n")[0]}
    assert e["s.a"] == e["s.b"] == ("property", 2, 2, "s", "public") and e["s.c"][1] == 3 and e["e.A"] == ("constant", 8, 8, "e", "public") and e["e.B"][1] == 9 and e["e.C"][1] == 10 and "s.z" not in e
    e = {x[1]: (x[2], x[11]) for x in extract.rows_of("a.cpp", "class T : public B {\n  int hid = 3;\npublic:\n  int shown;\n  int get() const { int local; return 1; }\nprotected:\n  std::vector<int> some;\n};\n")[0]}
    assert e["T.hid"] == ("property", "private") and e["T.shown"] == ("property", "public") and e["T.some"] == ("property", "internal") and e["T.get"][0] == "method" and "T.local" not in e
    calls = lambda p, t: {r[2] for r in extract.rows_of(p, t)[1] if r[3] == "call"}
    assert calls("a.c", "#define F(x) go(x)\n") == {"go"} and calls("a.rs", "pub(crate) fn x() { y(); }\n") == {"y"} and calls("a.go", 'package m\n\nimport (\n\t"fmt"\n)\n') == set()


def test_visibility_markers_signature():
    rows = {e[1]: e for e in extract.rows_of("a.rs", SOURCES["a.rs"][0])[0] if e[2] != "impl"}
    assert rows["Config"][7] == ["Clone"] and rows["Config"][11] == "public" and rows["Run"][11] == "internal" and rows["MAX"][11] == "private"
    assert rows["Config.new"][6] == "pub fn new() -> Self"
    py = {e[1]: e for e in extract.rows_of("a.py", SOURCES["a.py"][0])[0]}
    assert py["Service"][7] == ["dataclass"] and py["_hidden"][11] == "internal" and py["Service.get"][6] == "def get(self, i: int) -> Optional[dict]:"
    assert {e[6] for e in extract.rows_of("a.rb", SOURCES["a.rb"][0])[0]} == {None}
    first = extract.rows_of("b.py", "class A:\n    x = 1\n    y = 2\n")[0]
    assert [e[1] for e in first] == ["A", "A.y"]  # the first statement of a class body doesn't count


def test_json_keys_items_and_derived():
    doc = {"a": {"_b": {"c": 1}}, "list": [{"id": "x", "v": 2}, 3, [4]], "_d": True}
    items = documents.json_items(json.dumps(doc, indent=1))
    assert [(k, n, p, m) for k, n, p, _, _, _, m in items] == [("object", "a", None, None), ("object", "_b", "a", ["derived"]), ("property", "c", "_b", ["derived"]), ("array", "list", None, None), ("object", "x", "list", None), ("property", "id", "x", None), ("property", "v", "x", None), ("element", "[1]", "list", None), ("array", "[2]", "list", None), ("property", "_d", None, ["derived"])]
    assert items[0][3:6] == (2, 6, '"a": object') and items[7][5] == "list[1]"
    small = json.dumps({"key" + str(i): "value" * 4 for i in range(9)})
    assert documents.pretty_if_minified(small).count("\n") == 10 and documents.json_items("{broken") == [] and documents.json_items("[1]") == []


def test_toml_and_markdown():
    toml = documents.toml_items('name = "x"\n\n[settings]\ndebug = false\ntags = [\n  "a",\n]\n\n[settings.theme]\nsize = 1.5\n')
    assert [(k, n, p, a, b) for k, n, p, a, b, _, _ in toml] == [("property", "name", None, 1, 1), ("object", "settings", None, 3, 7), ("property", "debug", "settings", 4, 4), ("array", "tags", "settings", 5, 7), ("object", "theme", "settings", 9, 10), ("property", "size", "theme", 10, 10)]
    md = documents.markdown_items("# A\n\ntext\nmore\n\n## B\n```py\n# no heading\n```\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n> q\n# C\n1. x\n")
    assert [(k, n[:12], p, a, b) for k, n, p, a, b, _, _ in md] == [("section", "A", None, 1, 16), ("paragraph", "text", "A", 3, 4), ("section", "B", "A", 6, 16), ("code_block", "py", "B", 7, 9), ("list", "one", "B", 10, 11), ("table", "| a | b |", "B", 13, 15), ("blockquote", "q", "B", 16, 16), ("section", "C", None, 17, 18), ("list", "x", "C", 18, 18)]
    long = documents.markdown_items("# " + "x" * 70)[0][1]
    assert len(long) == 60 and long.endswith("...")


def test_yaml():
    pytest.importorskip("yaml")
    items = documents.yaml_items("name: x\nsettings:\n  debug: false\n  tags:\n    - a\n")
    assert [(k, n, p, a) for k, n, p, a, *_ in items] == [("property", "name", None, 1), ("object", "settings", None, 2), ("property", "debug", "settings", 3), ("array", "tags", "settings", 4)]
    items = documents.yaml_items("a:\n  - x\n  - y\n\n# note\nb: |\n  one\n  two\n\nc:\n  d: 1\n")
    assert [(n, a, b) for _, n, _, a, b, *_ in items] == [("a", 1, 3), ("b", 6, 8), ("c", 10, 11), ("d", 11, 11)]
    assert documents.markdown_items("---\ntitle: t\n---\n# H\n")[1][:3] == ("property", "title", "frontmatter")


def test_distributed_extraction(spark, tmp_path):
    for name, (text, _, _) in SOURCES.items():
        (tmp_path / name).write_text(text)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.py").write_text("a = 1\n")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "y.py").write_text("b = 1\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe x = 1")
    src = extract.discover(spark, str(tmp_path), [("", "build/")])
    assert {r["file"] for r in src.collect()} == set(SOURCES)
    e, r = extract.entities(src), extract.references(src)
    want = sum(len(extract.rows_of(n, t)[0]) for n, (t, _, _) in SOURCES.items())
    assert e.count() == want and r.where("name = 'helper'").count() >= 2
    assert e.where("file = 'a.py'").orderBy("seq").first()["name"] == "os"
    assert extract.entities(src.where("false")).count() == 0


def test_ignore_files(spark, tmp_path):
    for name in ("a.py", "gen/b.py", "gen/keep.py", "src/c.py", "src/out/d.py", "src/tmp_x.py", "lib/tmp_x.py", "deep/src/build/e.py", "keep.log.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# note\ngen/*\n!gen/keep.py\nbuild/\n*.log.py\n!keep.log.py\n")
    (tmp_path / "src/.gitignore").write_text("out/\n!out/d.py\ntmp_*.py\n")
    lines = extract.ignore_lines(str(tmp_path))
    assert lines[0] == ("", "gen/*") and ("src", "tmp_*.py") in lines
    got = sorted(r["file"] for r in extract.discover(spark, str(tmp_path), lines).collect())
    assert got == ["a.py", "gen/keep.py", "keep.log.py", "lib/tmp_x.py", "src/c.py"]
