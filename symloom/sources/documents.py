"""Entities of data formats (X12-X15): JSON, YAML, TOML and Markdown, as (kind, name, parent, first, last, sig, meta)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

IDENTITY = tuple("id key name text type".split())
Item = tuple[str, str, str | None, int, int, str | None, list[str] | None]


def pretty_if_minified(text: str) -> str:
    """Fewer than three lines and more than 80 bytes of JSON are laid out, so that lines tell values apart."""
    if len(text.splitlines()) < 3 and len(text.encode()) > 80:
        try:
            return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except ValueError:
            return text
    return text


def type_name(value: object) -> str:
    """SC15"""
    if isinstance(value, bool):
        return "boolean"
    return {dict: "object", list: "array", str: "string", type(None): "null"}.get(type(value), "number")


class _Json:
    """A JSON reader that remembers where values begin and end: (value, first line, last line, parts)."""

    _space = re.compile(r"[ \t\r\n]*")
    _scalar = re.compile(r"[^\s,\]}]+")

    def __init__(self, text: str):
        self.text, self.at, self.decode = text, 0, json.JSONDecoder()
        self.ends = [i for i, c in enumerate(text) if c == "\n"]

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_left(self.ends, at) + 1

    def skip(self) -> str:
        self.at = self._space.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self) -> tuple:
        c, begin = self.skip(), self.at
        if c not in "{[" or not c:
            v, self.at = self.decode.raw_decode(self.text, self.at)
            return v, self.line(begin), self.line(self.at - 1), None
        self.at += 1
        parts, close = [], "}" if c == "{" else "]"
        while (d := self.skip()) != close:
            if d == ",":
                self.at += 1
                continue
            if not d:
                raise ValueError("unclosed")
            key, key_line = None, self.line(self.at)
            if c == "{":
                key, self.at = self.decode.raw_decode(self.text, self.at)
                if self.skip() != ":":
                    raise ValueError("no colon")
                self.at += 1
            parts.append((key, key_line, self.value()))
        self.at += 1
        whole = {k: v[0] for k, _, v in parts} if c == "{" else [v[0] for _, _, v in parts]
        return whole, self.line(begin), self.line(self.at - 1), parts


def json_items(text: str) -> list[Item]:
    """X12; a broken document has none."""
    reader = _Json(text)
    try:
        root = reader.value()
    except (ValueError, RecursionError):
        return []
    out: list[Item] = []

    def members(node: tuple, parent: str | None, derived: bool) -> None:
        for key, line, sub in node[3]:
            value, _, last, parts = sub
            mine = derived or key.startswith("_")
            kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "property"
            out.append((kind, key, parent, line, last, f'"{key}": {type_name(value)}', ["derived"] if mine else None))
            if isinstance(value, dict):
                members(sub, key, mine)
            elif isinstance(value, list):
                first = next((v[0] for _, _, v in parts if isinstance(v[0], dict)), {})
                identity = next((k for k in IDENTITY if isinstance(first.get(k), str)), None)
                for i, (_, _, item) in enumerate(parts):
                    v, a, b, _ = item
                    named = v.get(identity) if isinstance(v, dict) and identity else None
                    name = named if isinstance(named, str) else f"[{i}]"
                    what = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "element"
                    out.append((what, name, key, a, b, f"{key}[{i}]", ["derived"] if mine else None))
                    if isinstance(v, dict):
                        members(item, name, mine)

    if isinstance(root[0], dict):
        members(root, None, False)
    return sorted(out, key=lambda x: x[3])


def yaml_items(text: str, parent: str | None = None, shift: int = 0) -> list[Item]:
    """Mapping keys; sequences aren't expanded. Needs PyYAML."""
    import yaml

    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return []
    out: list[Item] = []
    rows = [*text.split("\n"), ""]
    names = {"str": "string", "int": "number", "float": "number", "bool": "boolean", "null": "null"}

    def walk(node: object, above: str | None, depth: int) -> None:
        if not isinstance(node, yaml.MappingNode) or depth > 150:
            return
        for k, v in node.value:
            key = str(getattr(k, "value", ""))
            kind = "object" if isinstance(v, yaml.MappingNode) else "array" if isinstance(v, yaml.SequenceNode) else "property"
            told = kind if kind != "property" else names.get(v.tag.rpartition(":")[2], "string")
            first = k.start_mark.line + 1
            end = v.end_mark.line  # of what comes next, where a block ends
            if not rows[end][: v.end_mark.column].strip():
                end -= 1
                while end >= first and (not rows[end].strip() or rows[end].lstrip().startswith("#")):
                    end -= 1
            last = max(first, end + 1)
            out.append((kind, key, above, first + shift, last + shift, f"{key}: {told}", None))
            walk(v, key, depth + 1)

    walk(root, parent, 0)
    return sorted(out, key=lambda x: x[3])


_TABLE = re.compile(r"^\s*\[{1,2}\s*([^\[\]]+?)\s*\]{1,2}\s*(#.*)?$")
_KEY = re.compile(r"^\s*([A-Za-z0-9_-]+|\"[^\"]*\"|'[^']*')\s*=\s*(.*)$")


def toml_items(text: str) -> list[Item]:
    """Tables are objects, keys properties or arrays; sequences aren't expanded."""
    import datetime
    import tomllib

    try:
        root = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []

    def told(v: object) -> str:
        if isinstance(v, bool):
            return "boolean"
        kinds = ((str, "string"), (int, "integer"), (float, "float"), (dict, "table"), (list, "array"))
        return next((n for t, n in kinds if isinstance(v, t)), "datetime" if isinstance(v, (datetime.date, datetime.time)) else "string")

    lines, out = text.splitlines(), []
    heads = [(i, [p.strip().strip("\"'") for p in m[1].split(".")]) for i, x in enumerate(lines, 1) if (m := _TABLE.match(x))]
    at: dict[tuple, int] = {}
    for i, path in heads:
        for n in range(1, len(path) + 1):
            at.setdefault(tuple(path[:n]), i)
    for n, (i, path) in enumerate(heads):
        last = (heads[n + 1][0] if n + 1 < len(heads) else len(lines) + 1) - 1
        while last > i and not lines[last - 1].strip():
            last -= 1
        out.append(("object", path[-1], path[-2] if len(path) > 1 else None, i, last, f"[{'.'.join(path)}]", None))
    here: list[str] = []
    starts = dict(heads)
    i = 0
    while i < len(lines):
        i += 1
        if i in starts:
            here = starts[i]
        elif m := _KEY.match(lines[i - 1]):
            key, node = m[1].strip("\"'"), root
            for p in here:
                node = node.get(p, {}) if isinstance(node, dict) else node[-1].get(p, {}) if node else {}
            node = node[-1] if isinstance(node, list) and node else node
            value = node.get(key) if isinstance(node, dict) else None
            last = i
            while last < len(lines) and (lines_open(lines[i - 1 : last])):
                last += 1
            kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "property"
            out.append((kind, key, here[-1] if here else None, i, last, f"{key} = {told(value)}", None))
            i = last
    return sorted(out, key=lambda x: x[3])


def lines_open(lines: list[str]) -> bool:
    """Whether brackets or a triple quote are still open."""
    joined = "\n".join(lines)
    if joined.count('"""') % 2 or joined.count("'''") % 2:
        return True
    plain = re.sub(r"\"(\\.|[^\"\\])*\"|'[^']*'|#.*", "", joined)
    return plain.count("[") > plain.count("]") or plain.count("{") > plain.count("}")


_HEADING = re.compile(r"^\s*(#{1,6})(?: +(.*?))?\s*$")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})\s*(\S*)")
_BULLET = re.compile(r"^\s*(?:([-*]) |(\d+)\. )(.*)$")


def _short(s: str) -> str:
    return s if len(s) <= 60 else s[:57] + "..."


def markdown_items(text: str) -> list[Item]:
    """A state machine over lines; headings own what follows, up to the next of their level or above."""
    lines = text.splitlines()
    out: list[Item] = []
    stack: list[tuple[int, str, int]] = []
    at = 0

    def above() -> str | None:
        return stack[-1][1] if stack else None

    def close(level: int, last: int) -> None:
        while stack and stack[-1][0] >= level:
            _, name, first = stack.pop()
            out.append(("section", name, above(), first, last, lines[first - 1], None))

    def separator(i: int) -> bool:
        s = lines[i].strip() if i < len(lines) else ""
        return "|" in s and "-" in s and not set(s) - set("|-: ")

    def starts(i: int) -> bool:
        x = lines[i]
        return not x.strip() or bool(_HEADING.match(x) or _FENCE.match(x) or _BULLET.match(x)) or x.lstrip().startswith(">") or ("|" in x and separator(i + 1))

    if lines and lines[0].strip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), 0)
        if end:
            out.append(("frontmatter", "frontmatter", None, 1, end + 1, None, None))
            out += yaml_items("\n".join(lines[1:end]), "frontmatter", 1)
            at = end + 1
    while at < len(lines):
        x, first = lines[at], at + 1
        if not x.strip():
            at += 1
        elif (h := _HEADING.match(x)) and h[2]:
            close(len(h[1]), at)
            stack.append((len(h[1]), _short(h[2].strip()), first))
            at += 1
        elif f := _FENCE.match(x):
            fence, at = f[1], at + 1
            while at < len(lines) and not ((s := lines[at].strip()).startswith(fence) and not s.strip(fence[0])):
                at += 1
            at = min(len(lines), at + 1)
            out.append(("code_block", f[2] or "code", above(), first, at, f[2] or None, None))
        elif "|" in x and separator(at + 1):
            while at < len(lines) and "|" in lines[at]:
                at += 1
            out.append(("table", _short(x.strip()), above(), first, at, None, None))
        elif x.lstrip().startswith(">"):
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                at += 1
            out.append(("blockquote", _short(x.lstrip().lstrip(">").strip()), above(), first, at, None, None))
        elif b := _BULLET.match(x):
            while at < len(lines) and lines[at].strip() and (_BULLET.match(lines[at]) or lines[at][:1] in " \t"):
                at += 1
            out.append(("list", _short(b[3].strip()), above(), first, at, "ordered" if b[2] else "unordered", None))
        else:
            at += 1
            while at < len(lines) and not starts(at):
                at += 1
            out.append(("paragraph", _short(x.strip()), above(), first, at, None, None))
    close(1, len(lines))
    return sorted(out, key=lambda e: (e[3], -e[4]))


def script_blocks(text: str, extension: str) -> Iterator[tuple[str, str, int]]:
    """X11: (language, content, lines before it) of script blocks; the front matter of an .astro file is TypeScript."""
    if extension == "astro" and (m := re.match(r"\s*---\r?\n(.*?)\r?\n---", text, re.S)):
        yield "typescript", m[1], text.count("\n", 0, m.start(1))
    for m in re.finditer(r"<script\b([^>]*)>(.*?)</script\s*>", text, re.S | re.I):
        typed = re.search(r"lang\s*=\s*[\"']?(ts|tsx|typescript)\b", m[1], re.I)
        yield ("typescript" if typed else "javascript"), m[2], text.count("\n", 0, m.start(2))
