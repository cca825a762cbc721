"""Scalar functions as Column -> Column (SC1-SC8, SC10-SC13, SC20, SC21, M10): built-ins only, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {
    "python": "py pyi pyw", "rust": "rs", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "java": "java", "c": "c h",
    "cpp": "cpp cc cxx hpp hxx hh h++", "ruby": "rb rake gemspec", "csharp": "cs", "html": "html htm", "vue": "vue", "svelte": "svelte", "astro": "astro",
    "markdown": "md markdown", "json": "json", "yaml": "yaml yml", "toml": "toml",
}
EXTENSION_LANGUAGE = {e: lang for lang, exts in LANGUAGES.items() for e in exts.split()}

DEFINITION_KINDS = tuple("class enum fn function interface method module struct trait type_alias".split())
OUTLINE_KINDS = tuple("class enum fn function impl interface module section struct trait type_alias".split())

_SUFFIXES = r"(_test\.(rs|go|py|ts|js)|\.(test|spec)\.(ts|tsx|js|jsx)|Tests?\.java|_spec\.rb)$"
#: One pattern for all rules; ``[^/]*`` keeps a rule inside the file name.
TEST_PATH = r"^tests?/|/tests?/|/__tests__/|" + _SUFFIXES + r"|(^|/)test_[^/]*\.(py|rs)$|(^|/)Test[^/]*\.java$"


def tail_segment(s: Column) -> Column:
    """SC1: what follows the last ``:`` or ``.``."""
    return F.regexp_extract(s, r"([^:.]*)$", 1)


def qualified_tail(s: Column) -> Column:
    """SC2: what follows the last ``::``; null without one."""
    return F.when(s.contains("::"), F.substring_index(s, "::", -1))


def base_name(s: Column) -> Column:
    """SC3: what follows the last ``.``."""
    return F.substring_index(s, ".", -1)


def parent_dir(file: Column) -> Column:
    """SC4: what precedes the last ``/``; empty at the root."""
    return F.regexp_extract(file, r"^(?s)(.*)/[^/]*$", 1)


def lang_for(file: Column) -> Column:
    """SC5: the language of the text after the path's last ``.``; null if unknown or without a dot."""
    table = F.create_map(*(F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv))
    return F.when(file.contains("."), F.try_element_at(table, F.substring_index(file, ".", -1)))


def is_test_path(file: Column) -> Column:
    """SC6; ``\\`` counts as ``/``."""
    return F.replace(file, F.lit("\\"), F.lit("/")).rlike(TEST_PATH)


def body_length(start: Column, end: Column) -> Column:
    """SC7"""
    return F.greatest(F.lit(0).cast("long"), end - start + 1)


def collapse(s: Column) -> Column:
    """SC8: runs of blanks become one, none at the ends."""
    return F.trim(F.regexp_replace(s, r"[ \t\n\r\f\x0B]+", " "))


def truncate(s: Column, limit: int, mark: str = "...", keep: int | None = None) -> Column:
    """SC12: beyond ``limit`` characters the first ``keep`` (all of the limit) and a mark; limit 0 keeps all."""
    if limit <= 0:
        return s
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit if keep is None else keep), F.lit(mark))).otherwise(s)


def tidy_parens(s: Column) -> Column:
    """SC13: no blanks inside parentheses, no trailing comma before ``)``."""
    s = F.regexp_replace(s, r"\(\s+", "(")
    return F.regexp_replace(s, r",?\s*\)", ")")


def is_string_literal(s: Column) -> Column:
    """SC11"""
    return s.rlike(r"(?s)^(\".*\"|'.*'|`.*`|[\"'`])$")


def is_number(s: Column) -> Column:
    return s.rlike(r"(?i)^[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$")


def is_identifier(s: Column) -> Column:
    return s.rlike(r"^[\p{L}\p{N}_.]+$")


def is_comment(s: Column) -> Column:
    return F.trim(s).rlike(r"^(//|#|/\*|\*)")


def normal_kind(kind: Column) -> Column:
    """SC20"""
    return F.when(kind == "trait_impl", "impl").when(kind == "field", "property").when(kind == "procedure", "function").otherwise(kind)


def cell(value: Column) -> Column:
    """SC21: null as empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def token_estimate(s: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(s) + 3) / 4).cast("long")


def is_top_level(parent: Column, kind: Column) -> Column:
    """Q16"""
    return parent.isNull() & kind.isin(*OUTLINE_KINDS)
