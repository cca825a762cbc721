"""URL filtering with rules that are indexed by their rarest literal token.

Host rules (a host, a path prefix, a verdict) hold for the host and its subdomains; the longest that fits decides.
Where none does, pattern rules decide: ``*`` is any text, ``^`` a separator or the end, ``||`` the start of a host
label, ``|`` an end of the URL, ``@@`` in front allows. Every pattern is filed under the one of its literal tokens
(two or more of a-z, 0-9 between characters that can't extend it) that is rarest over all URLs of the table; patterns
without such a token are tried on each URL. A URL's tokens fetch the candidates, and only those run their regular
expressions. An allowing pattern beats a blocking one; no match means allow.

The corpus statistics are the counts of the rules' own tokens, so what reaches the driver is bounded by the rules.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no host rule and is allowed
unless a pattern matches its text. Rows that repeat are judged each by itself. Of equal rules the first counts. Only
page_id and url are read; other columns, of any name, don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import prepare, small

#: (host, path prefix, verdict)
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PATTERN_RULES = ["||ads.", "/track/*", "/banner^", "?utm_source=", "page=2&ref=", ".html|", "||blog.*/es/", "@@/en/*.html|", "@@||www.*/fr/", "#top|"]
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_token = re.compile(r"[a-z0-9]+")


def split_url(url: str | None) -> tuple[str, str]:
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_UPPER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def host_rule(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    best = None
    for h, p, verdict in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def regex(pattern: str) -> str:
    """The regular expression of a pattern, without ``@@``, for URLs whose A-Z are lower-cased."""
    p = pattern.removeprefix("@@").translate(_UPPER)
    head = r"^[^/?#]*://([^/?#]*\.)?" if p.startswith("||") else "^" if p.startswith("|") else ""
    tail = "$" if p.endswith("|") and len(p) > 1 else ""
    p = p.lstrip("|").removesuffix("|")
    body = "".join(".*" if c == "*" else r"([^a-z0-9_.%-]|$)" if c == "^" else re.sub(r"([^\w])", r"\\\1", c) for c in p)
    return head + body + tail


def literals(pattern: str) -> list[str]:
    """Tokens that a matching URL holds as whole tokens: those with a fixed other character on both sides."""
    p = pattern.removeprefix("@@").translate(_UPPER)
    closed_left, closed_right = p.startswith("|"), p.endswith("|")
    p = p.lstrip("|").removesuffix("|")
    out = []
    for m in _token.finditer(p):
        left = closed_left if m.start() == 0 else p[m.start() - 1] != "*"
        right = closed_right if m.end() == len(p) else p[m.end()] != "*"
        if left and right and len(m[0]) > 1:
            out.append(m[0])
    return out


@dataclass
class Index:
    by_token: dict[str, list[int]]
    always: list[int]
    rules: list[tuple[re.Pattern, bool]]

    def match(self, url: str) -> tuple[str, int]:
        """The verdict, and how many candidates ran their expression."""
        low = url.translate(_UPPER)
        tokens = dict.fromkeys(_token.findall(low))
        todo = [*self.always, *(i for t in tokens for i in self.by_token.get(t, ()))]
        hits = [self.rules[i][1] for i in todo if self.rules[i][0].search(low)]
        return ("allow" if not hits or any(hits) else "block"), len(todo)


def build(urls: DataFrame, patterns: list[str], column: str = "url") -> Index:
    """Files each pattern under its rarest token; rarity is the number of URLs of the whole table that hold it."""
    wanted = sorted({t for p in patterns for t in literals(p)})
    rarity: dict[str, int] = dict.fromkeys(wanted, 0)
    if wanted:
        low = F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        held = urls.select(F.explode(F.array_distinct(F.split(low, "[^a-z0-9]+"))).alias("t"))
        own = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
        rarity |= {r["t"]: r["count"] for r in held.join(small(own, 96 + max(map(len, wanted)), len(wanted)), "t").groupBy("t").count().collect()}
    by_token: dict[str, list[int]] = {}
    always, rules = [], []
    for i, p in enumerate(patterns):
        rules.append((re.compile(regex(p), re.S), p.startswith("@@")))
        own = literals(p)
        if own:
            by_token.setdefault(min(own, key=lambda t: (rarity[t], -len(t), t)), []).append(i)
        else:
            always.append(i)
    return Index(by_token, always, rules)


def judge(pages: DataFrame, host_rules: list[tuple[str, str, str]] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, candidates of every row."""
    spark = pages.sparkSession
    prepare(spark)
    host_rules = HOST_RULES if host_rules is None else host_rules
    sent = spark.sparkContext.broadcast((build(pages, PATTERN_RULES if patterns is None else patterns), host_rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hosts = sent.value
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                fits = host_rule(host, path, hosts)
                verdict, tried = (fits[1], 0) if fits else index.match(url or "")
                for o, x in zip(out, (host, path, fits[0] if fits else None, verdict, tried)):
                    o.append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(o, t) for o, t in zip(out, kinds))], ["page_id", "host", "path", "rule", "verdict", "candidates"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, candidates int")


def oracle() -> str:
    """DuckDB SQL for ``judge`` (without ``candidates``): every rule on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hosts = ", ".join(f"({quote(h)}, {quote(p)}, {quote(v)})" for h, p, v in HOST_RULES)
    hit = lambda ok: " OR ".join(f"regexp_matches(low, {quote(regex(p))})" for p in PATTERN_RULES if p.startswith("@@") == ok)
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH r(h, p, v) AS (VALUES {hosts}),
u AS (SELECT page_id, translate(coalesce(url, ''), {az}) AS low,
      CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {az}) AS host,
      regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT page_id, low, host, path, (SELECT max_by(h || p || ' ' || v, length(h || p)) FROM r
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fit FROM s)
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule,
       CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 2) WHEN {hit(True)} THEN 'allow' WHEN {hit(False)} THEN 'block' ELSE 'allow' END AS verdict
FROM f"""
