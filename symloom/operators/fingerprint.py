"""Content fingerprints (H1-H4, H7) as Column expressions: SHA-256 where the content decides, 16 hex digits for entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symloom.functions import scalars as S

COMMENT = r"^(//|#|/\*|\*)"
_QUOTES = ('"""', "'''")


def short(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 16)


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _joined(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, short(F.array_join(lines, "\n")))


def struct_hash(text: Column, start: Column, end: Column) -> Column:
    """H1: of the raw lines [start, end]."""
    return short(F.array_join(F.slice(F.split(text, "\n"), start.cast("int"), (end - start + 1).cast("int")), "\n"))


def body_hash_raw(text: Column) -> Column:
    """H3: of the trimmed, collapsed, non-empty lines; comments stay. Null if none is left."""
    return _joined(F.filter(F.transform(_lines(text), S.collapse), lambda x: x != ""))


def body_hash(text: Column) -> Column:
    """H2: as H3, without comment lines and docstring regions.

    A fold over the lines carries whether a triple quote is open; a line that opens and closes one is a docstring line.
    """
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, raw: Column) -> Column:
        x = S.collapse(raw)
        opened = acc["open"] != ""
        quote = F.when(x.startswith(_QUOTES[0]), _QUOTES[0]).when(x.startswith(_QUOTES[1]), _QUOTES[1]).otherwise("")
        again = F.when(quote != "", F.contains(F.substring(x, F.lit(4), F.length(x)), quote)).otherwise(False)
        now = F.when(opened, F.when(F.contains(x, acc["open"]), "").otherwise(acc["open"])).otherwise(F.when(again, "").otherwise(quote))
        skip = opened | (quote != "") | (x == "") | x.rlike(COMMENT)
        return F.struct(now.alias("open"), F.when(skip, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"))

    plain = ~F.contains(text, F.lit(_QUOTES[0])) & ~F.contains(text, F.lit(_QUOTES[1]))
    easy = F.filter(F.transform(_lines(text), S.collapse), lambda x: (x != "") & ~x.rlike(COMMENT))
    return _joined(F.when(plain, easy).otherwise(F.aggregate(_lines(text), state, step)["kept"]))


def sig_hash(sig: Column) -> Column:
    """H4: of the collapsed signature; null stays null."""
    return short(S.collapse(sig))


def file_hash(content: Column) -> Column:
    """H7"""
    return F.sha2(content, 256)
