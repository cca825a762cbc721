"""Extraction: (file, text) rows become entities and references.

``mapInArrow`` over rows of sources: a task parses file after file and yields rows, nothing is gathered. Hashes are
SHA-256 cut to 16 hex digits. A file that can't be parsed yields nothing.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import scalars as S
from symloom.schema import ENTITY_SCHEMA, REF_SCHEMA
from symloom.sources import code, documents

COMMENT = ("//", "#", "/*", "*", "*/")
BRACES = ("rust", "javascript", "typescript", "tsx", "go", "java", "c", "cpp", "csharp")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:16]


def _squeezed(lines: list[str]) -> str | None:
    kept = [" ".join(x.split()) for x in lines if x.strip()]
    return _hash("\n".join(kept)) if kept else None


def body_hash(lines: list[str]) -> str | None:
    """H2 of a code body: without blank lines, comment lines and docstrings."""
    kept, quote = [], ""
    for raw in lines:
        x = raw.strip()
        if quote:
            quote = "" if quote in x else quote
            continue
        opened = next((q for q in ('"""', "'''") if x.startswith(q)), "")
        if opened:
            quote = "" if opened in x[3:] else opened
            continue
        if x and not x.startswith(COMMENT):
            kept.append(raw)
    return _squeezed(kept)


def _decorator(line: str, language: str) -> bool:
    x = line.strip()
    if language == "rust":
        return x.startswith(("#[", "#!["))
    return x.startswith("[") if language == "csharp" else x.startswith("@")


def signature(lines: list[str], language: str) -> tuple[str | None, int]:
    """H5: the signature, and how many lines of the entity come before its body."""
    skip = 0
    while skip < len(lines) and _decorator(lines[skip], language):
        skip += 1
    if skip == len(lines) or not (language in BRACES or language == "python"):
        return None, len(lines)
    parts, depth = [], 0
    for i in range(skip, len(lines)):
        x = lines[i]
        if language in BRACES:
            if "{" in x:
                parts.append(x[: x.index("{")].strip())
                return _tidy(parts), i + 1
        else:
            colon = -1
            for j, c in enumerate(x):
                depth += (c in "([{") - (c in ")]}")
                if c == ":" and depth == 0:
                    colon = j
            if colon >= 0:
                sig = " ".join(" ".join([*parts, x[: colon + 1]]).split())
                return (sig if sig.startswith(("def ", "class ", "async def ")) else None), i if x[colon + 1 :].strip() else i + 1
        parts.append(x.strip())
    if language == "python":
        return None, len(lines)
    return _tidy(parts), len(lines)


def _tidy(parts: list[str]) -> str | None:
    sig = " ".join(" ".join(parts).split())
    sig = re.sub(r"\( +", "(", sig)
    return re.sub(r",? *\)", ")", sig).rstrip(",").strip() or None


_RUBY = "has_many belongs_to has_one has_and_belongs_to_many validates validate scope attr_accessor attr_reader attr_writer delegate before_action after_action".split()


def markers(lines: list[str], language: str) -> list[str] | None:
    """H6: decorators, derives and attributes, annotations, or class-level calls in Ruby."""
    out = []
    if language == "ruby":
        for x in lines:
            out += [m for m in _RUBY if re.match(rf"\s*{m}[ (:]", x)]
        return out or None
    for x in (y.strip() for y in lines):
        if _decorator(x, language) and language in ("python", "rust", "java", "csharp", "typescript", "tsx", "javascript"):
            inner = re.sub(r"^(#!?\[|\[|@)", "", x)
            inner = inner.rstrip("]") if language in ("rust", "csharp") else inner
            derived = re.match(r"derive\((.*?)\)?$", inner) if language == "rust" else None
            out += [p.strip() for p in (derived[1].split(",") if derived else [inner.split("(")[0]]) if p.strip()]
        elif x and not (language == "rust" and x.startswith("//")):
            if language != "python" or x.startswith(("def ", "class ", "async def ")):
                break
    return out or None


def language_of(path: str) -> str | None:
    return S.EXTENSION_LANGUAGE.get(path.rpartition(".")[2]) if "." in path else None


def rows_of(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Entity rows (schema order, without rank and blast) and reference rows of one file."""
    language = language_of(path)
    data = {"json": documents.json_items, "yaml": documents.yaml_items, "toml": documents.toml_items, "markdown": documents.markdown_items}
    entities, refs = [], []
    if language in data or path.endswith(".mdx"):
        text = documents.pretty_if_minified(text) if language == "json" else text
        lines = text.splitlines()
        for kind, name, parent, first, last, sig, meta in data.get(language, documents.markdown_items)(text):
            own = lines[first - 1 : last]
            entities.append((path, name, kind, first, last, parent, sig, meta, _squeezed(own), _hash(" ".join(sig.split())) if sig else None, _hash("\n".join(own)), None))
    else:
        if language in ("html", "vue", "svelte", "astro"):
            blocks = [(lang, body, shift) for lang, body, shift in documents.script_blocks(text, language)]
        else:
            blocks = [(language, text, 0)]
        lines = text.splitlines()
        for lang, body, shift in blocks:
            parsed = code.parse(body, lang) if lang else code.Parsed()
            for kind, name, parent, first, last, visibility in parsed.entities:
                begin = first + shift
                while begin > 1 and begin - 2 < len(lines) and lang in ("rust", "java", "csharp", "typescript", "javascript") and kind != "import" and _decorator(lines[begin - 2], lang):
                    begin -= 1  # attributes above belong to it
                own = lines[begin - 1 : last + shift]
                # a script inside a page has neither a signature nor a body of its own: pages are no language with rules for them
                whole_file = language not in ("html", "vue", "svelte", "astro")
                sig, before = signature(own, lang) if whole_file else (None, len(own))
                sig = None if kind == "import" else sig
                meta = markers(own, lang) if kind != "import" else None
                entities.append((path, name, kind, begin, last + shift, parent, sig, meta, body_hash(own[before:]), _hash(sig) if sig else None, _hash("\n".join(own)), visibility))
            refs += [(path, caller, name, kind, line + shift) for caller, name, kind, line in parsed.refs]
    entities.sort(key=lambda e: e[3])
    refs.sort(key=lambda r: r[4])
    return entities, refs


_E = pa.schema([("file", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("parent", pa.string()), ("sig", pa.string()), ("meta", pa.list_(pa.string())), ("body_hash", pa.string()), ("sig_hash", pa.string()), ("struct_hash", pa.string()), ("visibility", pa.string()), ("seq", pa.int64())])
_R = pa.schema([("file", pa.string()), ("caller", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int64()), ("seq", pa.int64())])


_I = pa.schema([("file", pa.string()), ("what", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("owner", pa.string()), ("seq", pa.int64())])


def _map(sources: DataFrame, pick: Callable[[list[tuple], list[tuple]], list[tuple]], arrow: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, text in zip(b.column("file").to_pylist(), b.column("text").to_pylist()):
                if path is not None and text is not None:
                    rows += pick(*rows_of(path, text))
            columns = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return sources.select("file", "text").mapInArrow(run, ddl)


def entities(sources: DataFrame) -> DataFrame:
    """Entities of (file, text), with ``seq`` in the order of each file."""
    from symloom.schema import conform

    ddl = ", ".join(f"{f.name} {'array<string>' if f.name == 'meta' else 'long' if pa.types.is_integer(f.type) else 'string'}" for f in _E)
    return conform(_map(sources, lambda e, r: [(*x, i) for i, x in enumerate(e)], _E, ddl), ENTITY_SCHEMA)


def references(sources: DataFrame) -> DataFrame:
    from symloom.schema import conform

    return conform(_map(sources, lambda e, r: [(*x, i) for i, x in enumerate(r)], _R, "file string, caller string, name string, kind string, line long, seq long"), REF_SCHEMA)


def items(sources: DataFrame) -> DataFrame:
    """Entities and uses of (file, text) in one list, each file parsed once: (file, what, kind, name, first, last, owner, seq)."""

    def pick(entities: list[tuple], refs: list[tuple]) -> list[tuple]:
        rows = [(e[0], "entity", e[2], e[1], e[3], e[4], e[5], i) for i, e in enumerate(entities)]
        return rows + [(r[0], "use", r[3], r[2], r[4], r[4], r[1], i) for i, r in enumerate(refs)]

    return _map(sources, pick, _I, "file string, what string, kind string, name string, first long, last long, owner string, seq long")


def discover(spark: SparkSession, root: str, ignore: list[tuple[str, str]] | None = None) -> DataFrame:
    """(file, text) of the known source files below ``root``; hidden paths and ignored ones drop out, so does what
    isn't UTF-8. ``ignore`` has (directory, line) of ignore files, outer directories first."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base.removeprefix("file://")) + "/", "")
    rows = rows.select(rel.alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    known = F.substring_index("file", ".", -1).isin(*S.EXTENSION_LANGUAGE, "mdx")
    rows = rows.where(known & F.col("text").isNotNull() & ~F.col("file").rlike(r"(^|/)\."))
    return rows.where(~ignored(F.col("file"), ignore)) if ignore else rows


def ignored(file: Column, ignore: list[tuple[str, str]]) -> Column:
    """Whether the last line that fits ignores: ``!`` lines take files back, unless a directory above them is ignored."""
    gone, out = F.lit(False), F.lit(False)
    for where, line in ignore:
        back = line.startswith("!")
        p = ignore_pattern(line.removeprefix("!").removeprefix("\\"), where)
        # a whole directory stays ignored whatever is said about files in it
        inside, itself = file.rlike(p + "/"), file.rlike(p + "$") if not line.endswith("/") else F.lit(False)
        gone = gone if back else gone | inside
        out = F.when(itself, F.lit(not back)).otherwise(out)
        gone = gone & ~inside if back else gone
    return gone | out


def ignore_lines(root: str) -> list[tuple[str, str]]:
    """(directory, line) of all .gitignore files below ``root``, outer directories first."""
    out = []
    for folder, below, names in os.walk(root):
        below[:] = sorted(b for b in below if not b.startswith("."))
        if ".gitignore" in names:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                lines = [x.rstrip("\n").rstrip() for x in f]
            own = os.path.relpath(folder, root).replace(os.sep, "/")
            out += [("" if own == "." else own, x) for x in lines if x and not x.startswith("#")]
    return out


def ignore_pattern(line: str, where: str = "") -> str:
    """The start of a regular expression over relative paths for an ignore line in directory ``where``."""
    anchored = "/" in line.strip("/") or line.startswith("/")
    body = re.escape(line.strip("/")).replace(r"\*\*/", "(.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return "^" + (re.escape(where) + "/" if where else "") + ("" if anchored else "(.*/)?") + body
