"""Entities and references of source code.

Python goes through its own syntax tree. The other languages share a scanner: comments and strings are blanked out
in place, declarations are found by one pattern a language, their ends by matching brackets (``end`` in Ruby), and
the enclosing declaration gives the parent. Members are named ``Parent.name``, except in C. Known gaps: bodies of
macros, declarations that span lines before their name, and generics that hold braces.
"""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass, field

Entity = tuple[str, str, str | None, int, int, str | None]  # kind, name, parent, first, last, visibility
Ref = tuple[str | None, str, str, int]  # caller, name, kind, line

_C_LIKE = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_SPACES = {
    "rust": r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
    "go": _C_LIKE + r"|`[^`]*`",
    "javascript": _C_LIKE + r"|`(?:\\.|[^`\\])*`",
    "ruby": r"#[^\n]*|^=begin.*?^=end|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
    "csharp": _C_LIKE + r"|@\"(?:\"\"|[^\"])*\"",
}
_WORDS = "pub import if for while switch return catch sizeof new delete throw else do match loop unsafe fn func def elif unless until in case when using lock fixed typeof await yield async function super this self".split()
_CONTROL = "if for while switch return catch else do elif unless until case when using lock typeof".split()
_NOT_A_TYPE = re.compile(r"\b(class|struct|interface|enum|record|namespace|return|new|using|package|import|else|throw|yield|await|goto|delegate)\b")
#: Calls that are part of a language or of any program; the last ``::`` or first ``.`` segment decides.
BUILTINS = {
    "rust": "println print eprintln format vec panic assert assert_eq write writeln Some None Ok Err Box Vec String unwrap expect clone into iter map collect derive cfg".split(),
    "python": "print len range str int float list dict set tuple isinstance super open type enumerate zip map filter sorted min max sum any all getattr setattr hasattr repr iter next abs round".split(),
    "javascript": "console require parseInt parseFloat String Number Boolean Array Object JSON Math Promise setTimeout setInterval clearTimeout fetch".split(),
    "go": "make len cap append copy delete panic recover print println new close string int byte error".split(),
    "java": "System String Integer Math Objects List Map println".split(),
    "c": "printf malloc free sizeof memcpy memset strlen strcmp fprintf sprintf exit assert calloc realloc".split(),
    "cpp": "printf malloc free sizeof move forward make_unique make_shared static_cast dynamic_cast std assert".split(),
    "ruby": "puts print p require require_relative raise attr_accessor attr_reader attr_writer include extend lambda proc format".split(),
    "csharp": "Console nameof typeof String Math Convert ToString".split(),
}


@dataclass
class Parsed:
    entities: list[Entity] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)


def parse(text: str, language: str) -> Parsed:
    if language == "python":
        return _python(text)
    if language in ("tsx", "typescript", "javascript", "rust", "go", "java", "c", "cpp", "ruby", "csharp"):
        return _Scanner(text, "typescript" if language == "tsx" else language).run()
    return Parsed()


# --- Python


def _python(text: str) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    public: set[str] | None = None
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            public = {e.value for e in node.value.elts if isinstance(e, ast.Constant)}

    def visibility(name: str) -> str:
        if name.startswith("__") and not name.endswith("__"):
            return "private"
        if public is not None:
            return "public" if name in public else "internal"
        return "internal" if name.startswith("_") and not name.endswith("__") else "public"

    def chain(f: ast.expr) -> str | None:
        if isinstance(f, ast.Name):
            return f.id
        if isinstance(f, ast.Attribute):
            head = chain(f.value)
            return f"{head}.{f.attr}" if head else f.attr
        return None

    def add(kind: str, name: str, parent: str | None, node: ast.AST, first: int | None = None) -> None:
        out.entities.append((kind, f"{parent}.{name}" if parent else name, parent, first or node.lineno, node.end_lineno, visibility(name)))

    def visit(node: ast.AST, parent: str | None, caller: str | None, depth: int) -> None:
        if depth > 150:
            return
        skip = None
        if isinstance(node, ast.ClassDef):  # the first expression statement or assignment of a class body never counts
            skip = next((s for s in node.body if isinstance(s, (ast.Expr, ast.Assign, ast.AnnAssign))), None)
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                add("method" if parent else "function", child.name, parent, child, first)
                name = f"{parent}.{child.name}" if parent else child.name
                visit(child, parent or child.name, name, depth + 1)
            elif isinstance(child, ast.ClassDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                add("class", child.name, parent, child, first)
                visit(child, child.name, f"{parent}.{child.name}" if parent else child.name, depth + 1)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                head = f"{'.' * child.level}{child.module or ''}." if isinstance(child, ast.ImportFrom) else ""
                for a in child.names:
                    name = (head + a.name).replace("..", ".") if isinstance(child, ast.ImportFrom) and not child.level else head + a.name
                    out.entities.append(("import", name, parent, child.lineno, child.end_lineno, None))
                    out.refs.append((caller, name, "import", child.lineno))
            else:
                assigned = child.targets if isinstance(child, ast.Assign) else [child.target] if isinstance(child, ast.AnnAssign) else []
                if assigned and child is not skip and isinstance(node, (ast.Module, ast.ClassDef)):
                    for t in assigned:
                        if isinstance(t, ast.Name):
                            add("constant" if t.id.isupper() and len(t.id) > 1 else "variable", t.id, parent, child)
                if isinstance(child, ast.Call):
                    name = chain(child.func)
                    if name and name.split(".")[0] not in BUILTINS["python"]:
                        out.refs.append((caller, name, "call", child.lineno))
                visit(child, parent, caller, depth + 1)

    visit(tree, None, None, 0)
    return out


# --- the shared scanner

_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|readonly|virtual|override|async|export|default|declare|const|extern|unsafe|synchronized|inline|new)\s+)*)"
_TYPE = r"[A-Za-z_][\w.:<>\[\],?&* ]*?[\s*&]"
#: (kind, pattern with groups ``name``, optionally ``mods`` and ``parent``, whether a body in braces follows)
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*)fn\s+(?P<name>\w+)"),
        ("struct", r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)struct\s+(?P<name>\w+)"),
        ("enum", r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)enum\s+(?P<name>\w+)"),
        ("interface", r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?)trait\s+(?P<name>\w+)"),
        ("type_alias", r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)type\s+(?P<name>\w+)"),
        ("module", r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)mod\s+(?P<name>\w+)"),
        ("constant", r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:const|static(?:\s+mut)?)\s+(?P<name>[A-Z_]\w*)\s*:"),
        ("impl", r"^[ \t]*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[\w:<>, ']+\s+for\s+)?(?P<name>\w+)"),
        ("import", r"^[ \t]*(?:pub\s+)?use\s+(?P<name>[^;{]+?)\s*;"),
    ],
    "go": [
        ("function", r"^func\s+(?P<name>\w+)\s*[(\[]"),
        ("method", r"^func\s+\(\s*\w*\s*\*?(?P<parent>\w+)[^)]*\)\s*(?P<name>\w+)\s*\("),
        ("struct", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("type_alias", r"^type\s+(?P<name>\w+)\s+=?\s*(?!struct|interface)[\w*\[\].]+"),
        ("constant", r"^const\s+(?P<name>\w+)"),
        ("variable", r"^var\s+(?P<name>\w+)"),
        ("module", r"^package\s+(?P<name>\w+)"),
    ],
    "java": [
        ("class", r"^[ \t]*" + _MODS + r"class\s+(?P<name>\w+)"),
        ("interface", r"^[ \t]*" + _MODS + r"interface\s+(?P<name>\w+)"),
        ("enum", r"^[ \t]*" + _MODS + r"enum\s+(?P<name>\w+)"),
        ("annotation", r"^[ \t]*" + _MODS + r"@interface\s+(?P<name>\w+)"),
        ("struct", r"^[ \t]*" + _MODS + r"record\s+(?P<name>\w+)\s*\("),
        ("method", r"^[ \t]+" + _MODS + r"(?:<[^>]+>\s*)?" + _TYPE + r"\s*(?P<name>\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?\s*[{;]"),
        ("constructor", r"^[ \t]+(?P<mods>(?:public|private|protected)\s+)?(?P<name>[A-Z]\w*)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?\s*\{"),
        ("property", r"^[ \t]+" + _MODS + _TYPE + r"\s*(?P<name>\w+)\s*(?:=[^=;][^;]*)?;"),
        ("import", r"^import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;"),
        ("module", r"^package\s+(?P<name>[\w.]+)\s*;"),
    ],
    "c": [
        ("struct", r"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+(?P<name>\w+)\s*\{"),
        ("enum", r"^[ \t]*(?:typedef\s+)?enum\s+(?P<name>\w+)\s*\{"),
        ("type_alias", r"^typedef\s+[^;{}()]*?(?P<name>\w+)\s*;"),
        ("function", r"^(?P<mods>(?:static\s+|inline\s+|extern\s+)*)" + _TYPE + r"\s*(?P<name>\w+)\s*\([^;{}]*\)\s*\{"),
        ("variable", r"^(?P<mods>(?:static\s+|const\s+|extern\s+)*)" + _TYPE + r"\s*(?P<name>\w+)(?:\[[^\]]*\])?\s*=\s*[^=]"),
        ("macro", r"^[ \t]*#\s*define\s+(?P<name>\w+)\("),
        ("constant", r"^[ \t]*#\s*define\s+(?P<name>\w+)(?=\s)"),
        ("import", r"^[ \t]*#\s*include\s*[<\"](?P<name>[^>\"\n]+)[>\"]"),
    ],
    "ruby": [
        ("function", r"^[ \t]*def\s+(?P<name>(?:self\.)?[\w?!=]+)"),
        ("class", r"^[ \t]*class\s+(?P<name>[A-Z]\w*)"),
        ("module", r"^[ \t]*module\s+(?P<name>[A-Z]\w*)"),
        ("constant", r"^[ \t]*(?P<name>[A-Z][A-Z0-9_]+)\s*=[^=~]"),
        ("property", r"^[ \t]*(?P<name>@@?\w+)\s*=[^=~]"),
        ("variable", r"^(?P<name>[a-z_]\w*)\s*=[^=~]"),
        ("import", r"^[ \t]*require(?:_relative)?\s*\(?\s*[\"'](?P<name>[^\"'\n]+)"),
    ],
    "csharp": [
        ("module", r"^[ \t]*namespace\s+(?P<name>[\w.]+)"),
        ("class", r"^[ \t]*" + _MODS + r"class\s+(?P<name>\w+)"),
        ("struct", r"^[ \t]*" + _MODS + r"(?:record\s+struct|record\s+class|record|struct)\s+(?P<name>\w+)"),
        ("interface", r"^[ \t]*" + _MODS + r"interface\s+(?P<name>\w+)"),
        ("enum", r"^[ \t]*" + _MODS + r"enum\s+(?P<name>\w+)"),
        ("type_alias", r"^[ \t]*" + _MODS + r"delegate\s+[\w<>,\[\]?]+\s+(?P<name>\w+)"),
        ("method", r"^[ \t]+" + _MODS + _TYPE + r"\s*(?P<name>\w+)\s*(?:<[^>]+>)?\([^;{}]*\)\s*(?:where[^{]+)?(?:\{|=>|;)"),
        ("constructor", r"^[ \t]+(?P<mods>(?:public|private|protected|internal|static)\s+)+(?P<name>[A-Z]\w*)\s*\([^;{}]*\)\s*(?::[^{]+)?\{"),
        ("property", r"^[ \t]+" + _MODS + _TYPE + r"\s*(?P<name>\w+)\s*(?:\{[ \t]*(?:get|set|init|private[ \t]+get)|=>|=[^=>;][^;]*;|;)"),
        ("import", r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<name>[\w.]+)\s*;"),
    ],
    "javascript": [
        ("class", r"^[ \t]*" + _MODS + r"class\s+(?P<name>\w+)"),
        ("function", r"^[ \t]*" + _MODS + r"function\s*\*?\s*(?P<name>\w+)"),
        ("function", r"^[ \t]*(?P<mods>export\s+)?(?:const|let|var)\s+(?P<name>\w+)(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={\n]+)?=>|\w+\s*=>)"),
        ("variable", r"^(?P<mods>export\s+)?(?P<const>const|let|var)\s+(?P<name>\w+)(?:\s*:[^=\n]+)?\s*=(?!\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={\n]+)?=>|\w+\s*=>))"),
        ("method", r"^[ \t]+(?P<mods>(?:(?:public|private|protected|static|async|readonly|override|abstract)\s+)*)(?P<accessor>(?:get|set)\s+)?\*?(?P<name>#?\w+)\s*(?:<[^>]+>)?\([^;{}]*\)\s*(?::\s*[^{;=]+)?\{"),
        ("import", r"^import\s[^;\n]*?from\s*[\"'](?P<name>[^\"'\n]+)|^import\s*[\"'](?P<name2>[^\"'\n]+)"),
    ],
}
DECLARATIONS["typescript"] = DECLARATIONS["javascript"] + [
    ("interface", r"^[ \t]*" + _MODS + r"interface\s+(?P<name>\w+)"),
    ("type_alias", r"^[ \t]*" + _MODS + r"type\s+(?P<name>\w+)(?:<[^=]*>)?\s*="),
    ("enum", r"^[ \t]*" + _MODS + r"enum\s+(?P<name>\w+)"),
    ("module", r"^[ \t]*" + _MODS + r"namespace\s+(?P<name>[\w.]+)"),
    ("property", r"^[ \t]+(?P<mods>(?:(?:public|private|protected|static|readonly|declare)\s+)*)(?P<name>#?\w+)[?!]?\s*:\s*[^;{}()\n]+;"),
]
DECLARATIONS["cpp"] = [
    *(d for d in DECLARATIONS["c"] if d[0] not in ("function", "struct")),
    ("class", r"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)[^;{}()]*\{"),
    ("struct", r"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+(?P<name>\w+)[^;{}()]*\{"),
    ("module", r"^[ \t]*namespace\s+(?P<name>[\w:]+)\s*\{"),
    ("type_alias", r"^[ \t]*using\s+(?P<name>\w+)\s*="),
    ("function", r"^[ \t]*(?P<mods>(?:static\s+|inline\s+|virtual\s+|constexpr\s+|explicit\s+|extern\s+)*)(?:" + _TYPE + r"\s*)?(?:(?:\w+::)*(?P<parent>\w+)::)?(?P<name>~?\w+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{;]+)?\{"),
    ("import", r"^[ \t]*using\s+(?:namespace\s+)?(?P<name>[\w:]+)\s*;"),
]
_COMPILED = {lang: [(k, re.compile(p, re.M)) for k, p in ds] for lang, ds in DECLARATIONS.items()}
_HOLDERS = ("class", "struct", "interface", "impl", "enum", "annotation", "module")
_OPEN, _CLOSE = "([{", ")]}"


class _Scanner:
    def __init__(self, text: str, language: str):
        self.text, self.lang = text, language
        pattern = _SPACES.get("javascript" if language == "typescript" else language, _C_LIKE)
        self.plain = re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S | re.M)
        self.ends = [i for i, c in enumerate(text) if c == "\n"]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.ends, at) + 1

    def end_of(self, at: int) -> int:
        """Where a declaration that begins at ``at`` ends: its closing brace, or the first ``;`` or line end outside brackets."""
        if self.lang == "ruby":
            return self._ruby_end(at)
        depth, p, seen = 0, self.plain, False
        for i in range(at, len(p)):
            c = p[i]
            if c in _OPEN:
                depth += 1
                seen = seen or c == "{"
            elif c in _CLOSE:
                depth -= 1
                if depth <= 0 and c == "}" and seen:
                    return i
                if depth < 0:
                    return i - 1
            elif c == ";" and depth == 0:
                return i
            elif c == "\n" and depth == 0 and self.lang in ("go", "javascript", "typescript") and i > at and p[at:i].strip() and not re.match(r"\s*[{.?:=]", p[i:]) and p[:i].rstrip()[-1:] not in "=,(":
                return i - 1
        return len(p) - 1

    def _ruby_end(self, at: int) -> int:
        depth = 0
        for m in re.finditer(r"^[ \t]*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b|\bend\b", self.plain[at:], re.M):
            depth += -1 if m[0].strip() == "end" else 1
            if depth == 0:
                return at + m.end() - 1
        return len(self.plain) - 1

    def visibility(self, kind: str, name: str, mods: str, inside: str | None) -> str | None:
        words = set(re.findall(r"\w+", mods))
        if kind == "import":
            return None
        if self.lang == "rust":
            return "internal" if "pub(" in mods.replace(" ", "") else "public" if "pub" in words else "private"
        if self.lang == "go":
            return "public" if name[:1].isupper() else "private"
        if self.lang == "ruby":
            return "private" if name.startswith("_") else "public"
        if self.lang in ("c", "cpp"):
            return "private" if "static" in words else "public"
        if self.lang in ("javascript", "typescript"):
            if inside:
                return "private" if name.startswith("#") or "private" in words else "internal" if "protected" in words or (name.startswith("_") and self.lang == "javascript") else "public"
            return "public" if "export" in words else "private"
        if self.lang == "java":
            return "public" if "public" in words else "private" if "private" in words else "internal"
        return "public" if "public" in words else "internal" if words & {"protected", "internal"} else "private"

    def run(self) -> Parsed:
        found = []
        for kind, pattern in _COMPILED[self.lang]:
            source = self.text if kind == "import" else self.plain
            for m in pattern.finditer(source):
                g = m.groupdict()
                which = "name" if g.get("name") else "name2"
                name, at = m[which], m.start(which)
                if not self.plain[at : at + 1].strip() and kind != "import" or name in _CONTROL:
                    continue
                if kind in ("property", "method", "constructor", "variable") and _NOT_A_TYPE.search(m[0][: at - m.start()]):
                    continue
                begin = m.start() + len(m[0]) - len(m[0].lstrip())
                if kind == "import" and not self.plain[begin : begin + 1].strip():
                    continue  # in a comment
                whole = kind in ("import", "macro") or m[0][-1:] == ";" or (kind == "constant" and self.lang in ("c", "cpp"))
                last = m.end() - 1 if whole else self.end_of(begin)
                found.append([begin, max(last, m.end() - 1), kind, re.sub(r"\s+", " ", name).strip(), g.get("mods") or "", g.get("parent"), g])
        found.sort(key=lambda f: (f[0], -f[1]))
        out, stack, taken = Parsed(), [], set()
        spans: list[tuple[int, int, str]] = []
        for begin, last, kind, name, mods, owner, g in found:
            if (begin, name) in taken:
                continue
            while stack and stack[-1][1] < begin:
                stack.pop()
            inside = stack[-1] if stack else None
            holder = inside[3].rpartition(".")[2] if inside and inside[2] in _HOLDERS and inside[2] != "module" else None
            if inside and inside[2] not in _HOLDERS and kind in ("property", "method", "constructor", "variable") and self.lang != "ruby":
                continue  # statements of a body
            if kind in ("property", "constructor") and not holder and self.lang != "ruby":
                continue
            if kind == "method" and not owner and not holder:
                continue
            parent = owner or holder
            if kind == "function" and parent:
                kind = "method"
            if kind == "method" and parent and name == parent and self.lang in ("java", "csharp"):
                kind = "constructor"
            if kind in ("method", "constructor") and g.get("accessor"):
                kind = "property"
            if kind == "variable" and name.isupper() and (g.get("const") in (None, "const")):
                kind = "constant"
            if kind == "property" and self.lang in ("java", "csharp") and ({"static", "final"} <= set(mods.split()) or "const" in mods.split() or {"static", "readonly"} <= set(mods.split())):
                kind = "constant"
            if kind == "struct" and self.lang == "java" and "record" not in self.plain[begin : begin + 200]:
                continue
            taken.add((begin, name))
            full = f"{parent}.{name}" if parent and kind not in ("impl", "import") and self.lang != "c" else name
            out.entities.append((kind, full, parent if kind != "impl" else None, self.line(begin), self.line(last), self.visibility(kind, name, mods, parent)))
            if kind not in ("import", "constant", "variable", "property", "type_alias", "macro"):
                stack.append((begin, last, kind, name))
                spans.append((begin, last, full))
            if kind == "import":
                out.refs.append((None, name, "import", self.line(begin)))
        if self.lang == "go":
            for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|([\w.]*\s*\"[^\"\n]+\"))", self.text, re.M):
                for x in re.finditer(r"\"([^\"\n]+)\"", m[0]):
                    at = self.line(m.start() + x.start())
                    out.entities.append(("import", x[1], None, at, at, None))
                    out.refs.append((None, x[1], "import", at))
            out.entities += self._go_fields(found)
        if self.lang in ("c", "cpp"):
            out.entities += self._members(found, {(e[1].rpartition(".")[2], e[3]) for e in out.entities})
        out.refs += self._uses(spans)
        out.entities.sort(key=lambda e: e[3])
        out.refs.sort(key=lambda r: r[3])
        return out

    def _members(self, found: list, known: set[tuple[str, int]]) -> list[Entity]:
        """Fields of structs and classes, and enumerators, with the type's name in front; bodies inside a body are left out."""
        rows = []
        for begin, last, kind, name, *_ in found:
            at = self.plain.find("{", begin, last + 1)
            if kind not in ("struct", "class", "enum") or at < 0:
                continue
            access, start, depth = "private" if kind == "class" else "public", at + 1, 0
            for i in range(at + 1, last + 1):
                c = self.plain[i]
                depth += (c in _OPEN) - (c in _CLOSE)
                if depth > 0 or not (c == "," and kind == "enum" or c in ";}" or c == ":" and kind != "enum"):
                    continue
                part, lead = self.plain[start:i], start
                start = i + 1
                if c == ":":
                    if (word := part.split()[-1:]) and word[0] in ("public", "private", "protected"):
                        access = "internal" if word[0] == "protected" else word[0]
                    else:
                        start = lead  # a bit field or a qualified name
                    continue
                if kind == "enum":
                    if m := re.match(r"\s*(\w+)", part):
                        line = self.line(lead + m.start(1))
                        rows.append(("constant", f"{name}.{m[1]}", name, line, self.line(i - 1), "public"))
                elif c == ";" and "(" not in part and "{" not in part and not re.match(r"\s*(typedef|using|friend|static_assert)\b", part):
                    names = [m[1] for x in part.split(",") if (m := re.search(r"(\w+)\s*(?:\[[^\]]*\]\s*)*(?:=.*|:\s*\d+\s*)?$", x, re.S))]
                    line = self.line(lead + len(part) - len(part.lstrip()))
                    if len(part.split()) > 1 or "*" in part:
                        rows += [("property", f"{name}.{n}", name, line, self.line(i), access) for n in names if (n, line) not in known]
        return rows

    def _go_fields(self, found: list) -> list[Entity]:
        rows = []
        for begin, last, kind, name, *_ in found:
            if kind in ("struct", "interface"):
                body = self.plain.find("{", begin)
                pattern = r"^[ \t]+(\w+)[ \t]+[\w*\[\].]" if kind == "struct" else r"^[ \t]+(\w+)\("
                for m in re.finditer(pattern, self.plain[body:last], re.M):
                    at = self.line(body + m.start(1))
                    rows.append(("property" if kind == "struct" else "method", f"{name}.{m[1]}", name, at, at, self.visibility("property", m[1], "", name)))
        return rows

    def _uses(self, spans: list[tuple[int, int, str]]) -> list[Ref]:
        skip = set(_WORDS) | set(BUILTINS.get("javascript" if self.lang == "typescript" else self.lang, ()))
        starts = [s[0] for s in spans]

        def caller(at: int) -> str | None:
            for i in range(bisect.bisect_right(starts, at) - 1, -1, -1):
                if spans[i][0] <= at <= spans[i][1]:
                    return spans[i][2]
            return None

        declared = {(s[0], s[2].rpartition(".")[2]) for s in spans}
        heads = {self.line(a): n for a, n in declared}
        rows: list[Ref] = []
        fresh = r"\bnew\s+([\w.]+)" if self.lang in ("javascript", "typescript", "java", "cpp", "csharp") else None
        if fresh:
            rows += [(caller(m.start()), m[1], "instantiation", self.line(m.start())) for m in re.finditer(fresh, self.plain)]
        call = r"(?<![\w.:])((?:[A-Za-z_$]\w*(?:::|\.|->))*[A-Za-z_$]\w*[?!]?)\s*(?:::<[^>]*>)?\("
        for m in re.finditer(call, self.plain):
            name, line = m[1].replace("->", "."), self.line(m.start())
            tail = re.split(r"::|\.", name)[-1]
            first = re.split(r"::|\.", name)[0]
            before = self.plain[max(0, m.start() - 5) : m.start()]
            if self.lang in ("c", "cpp") and re.match(r"[ \t]*#\s*define\s+$", self.plain[self.plain.rfind("\n", 0, m.start()) + 1 : m.start()]):
                continue  # the head of a macro
            if tail in skip or first in skip and first not in ("self", "this", "super") or heads.get(line) == tail or re.search(r"\b(new|fn|func|def)\s$", before):
                continue
            rows.append((caller(m.start()), name, "call", line))
        if self.lang in ("rust", "typescript", "go", "java", "csharp", "cpp", "c"):
            typed = r"(?::|->)\s*&?(?:mut\s+)?([A-Z]\w+)" if self.lang in ("rust", "typescript") else r"(?<![\w.])\*?([A-Z]\w+)\s+\w+\s*[,)=;]" if self.lang != "go" else r"\w\s+\*?([A-Z]\w+)\s*[,){]"
            rows += [(caller(m.start()), m[1], "type_annotation", self.line(m.start())) for m in re.finditer(typed, self.plain)]
        return rows
