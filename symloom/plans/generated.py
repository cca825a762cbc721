"""Queries over sources that are made from ``part``, a file for each row, and over stores that are written and reread.

What a file must yield is told by hand, line by line; SQL fills in the names. So each extractor runs over a whole table
and is held against what the language says, not against itself.
"""

from __future__ import annotations

import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import scalars as S
from symloom.functions import textdiff
from symloom.operators import diff, query
from symloom.plans import project as P
from symloom.plans.catalog import reg
from symloom.sources import extract, git, jsonl
from symloom.storage import fresh_path

#: (source, what it yields): ``kind name first last parent`` of an entity, ``> kind name line caller`` of a use.
LANGUAGES = {
    "x01_rust": ("rs", """use std::fmt;

#[derive(Clone)]
pub struct T{n} {
    pub port: u16,
}

impl T{n} {
    pub fn get_{n}(&self) -> u16 {
        compute_{k}(1)
    }
}

pub(crate) trait R{n} {
}

const MAX_{k}: u8 = 3;

fn {n}(a: u8) {
    helper(a);
}
""", """import std::fmt 1 1
struct T{n} 3 6
impl T{n} 8 12
method T{n}.get_{n} 9 11 T{n}
interface R{n} 14 15
constant MAX_{k} 17 17
function {n} 19 21
> import std::fmt 1
> call compute_{k} 10 T{n}.get_{n}
> call helper 20 {n}"""),
    "x02_python": ("py", '''import os
from typing import Optional

MAX_{k} = {k}

@dataclass
class T{n}:
    """Doc."""

    def get_{n}(self, i: int) -> Optional[dict]:
        return self.db.find(i)

def _{n}(x):
    return compute_{k}(x)
''', """import os 1 1
import typing.Optional 2 2
constant MAX_{k} 4 4
class T{n} 6 11
method T{n}.get_{n} 10 11 T{n}
function _{n} 13 14
> import os 1
> import typing.Optional 2
> call self.db.find 11 T{n}.get_{n}
> call compute_{k} 14 _{n}"""),
    "x03_javascript": ("js", """import x from './x';

export class T{n} {
  get_{n}(a) {
    return compute_{k}(a);
  }
}

const MAX_{k} = 3;

function {n}(a) {
  return new Thing(a);
}
""", """import ./x 1 1
class T{n} 3 7
method T{n}.get_{n} 4 6 T{n}
constant MAX_{k} 9 9
function {n} 11 13
> import ./x 1
> call compute_{k} 5 T{n}.get_{n}
> instantiation Thing 12 {n}"""),
    "x04_typescript": ("ts", """import { R } from 'express';

interface I{n} {
    host: string;
}

export class T{n} {
    get_{n}(id: number): number {
        return compute_{k}(id);
    }
}

export type A{n} = string;

enum E{n} { Red }
""", """import express 1 1
interface I{n} 3 5
property I{n}.host 4 4 I{n}
class T{n} 7 11
method T{n}.get_{n} 8 10 T{n}
type_alias A{n} 13 13
enum E{n} 15 15
> import express 1
> call compute_{k} 9 T{n}.get_{n}"""),
    "x05_go": ("go", """package main

import (
\t"fmt"
)

type T{n} struct {
\tPort int
}

func (c *T{n}) Check() error {
\treturn fmt.Errorf("x", c.Port)
}

func f_{n}() {
\tcompute_{k}()
}
""", """module main 1 1
import fmt 4 4
struct T{n} 7 9
property T{n}.Port 8 8 T{n}
method T{n}.Check 11 13 T{n}
function f_{n} 15 17
> import fmt 4
> call fmt.Errorf 12 T{n}.Check
> call compute_{k} 16 f_{n}"""),
    "x06_java": ("java", """package a.b;

import java.util.Map;

public class T{n} {
    private static final int MAX_{k} = 3;
    protected int size;

    public T{n}(int n) {
        compute_{k}(n);
    }

    public int get_{n}(int a) {
        return new Baz(a);
    }
}
""", """module a.b 1 1
import java.util.Map 3 3
class T{n} 5 16
constant T{n}.MAX_{k} 6 6 T{n}
property T{n}.size 7 7 T{n}
constructor T{n}.T{n} 9 11 T{n}
method T{n}.get_{n} 13 15 T{n}
> import java.util.Map 3
> call compute_{k} 10 T{n}.T{n}
> instantiation Baz 14 T{n}.get_{n}"""),
    "x07_c": ("c", """#include <stdio.h>
#define MAX_{k} 3
#define SQ_{k}(x) ((x)*(x))

struct s_{n} {
    int a;
};

enum e_{n} {
    RED_{k},
    BLUE
};

static int {n}(int a) {
    return compute_{k}(a);
}
""", """import stdio.h 1 1
constant MAX_{k} 2 2
macro SQ_{k} 3 3
struct s_{n} 5 7
property s_{n}.a 6 6 s_{n}
enum e_{n} 9 12
constant e_{n}.RED_{k} 10 10 e_{n}
constant e_{n}.BLUE 11 11 e_{n}
function {n} 14 16
> import stdio.h 1
> call compute_{k} 15 {n}"""),
    "x08_cpp": ("cpp", """#include <vector>

namespace ns_{k} {

class T{n} {
public:
    int get_{n}() const {
        return compute_{k}(1);
    }
private:
    int size;
};

}
""", """import vector 1 1
module ns_{k} 3 14
class T{n} 5 12
method T{n}.get_{n} 7 9 T{n}
property T{n}.size 11 11 T{n}
> import vector 1
> call compute_{k} 8 T{n}.get_{n}"""),
    "x09_ruby": ("rb", """require 'json'

module M{k}
  class T{n}
    def get_{n}(x)
      compute_{k}(x)
    end
  end
end
""", """import json 1 1
module M{k} 3 9
class T{n} 4 8
method T{n}.get_{n} 5 7 T{n}
> import json 1
> call compute_{k} 6 T{n}.get_{n}"""),
    "x10_csharp": ("cs", """using System;

namespace App{k} {
    public class T{n} {
        public const int Max = 4;
        public string Name { get; set; }

        public int Get_{n}(int a) {
            return Compute_{k}(a);
        }
    }
}
""", """import System 1 1
module App{k} 3 12
class T{n} 4 11
constant T{n}.Max 5 5 T{n}
property T{n}.Name 6 6 T{n}
method T{n}.Get_{n} 8 10 T{n}
> import System 1
> call Compute_{k} 9 T{n}.Get_{n}"""),
    "x11_components": ("vue", """<template>
</template>
<script lang="ts">
export function setup_{n}(): void {
  compute_{k}();
}
</script>
<script>
const {n} = 1;
</script>
""", """function setup_{n} 4 6
variable {n} 9 9
> call compute_{k} 5 setup_{n}"""),
    "x12_json_nested": ("json", """{
  "name": "{n}",
  "settings": {
    "size": {k},
    "_raw": {
      "x": 1
    }
  },
  "list": [
    {
      "id": "{n}",
      "v": 2
    },
    3
  ]
}
""", """property name 2 2
object settings 3 8
property size 4 4 settings
object _raw 5 7 settings
property x 6 6 _raw
array list 9 15
object {n} 10 13 list
property id 11 11 {n}
property v 12 12 {n}
element [1] 14 14 list"""),
    "x13_yaml": ("yaml", """name: {n}
settings:
  debug: false
  tags:
    - a
    - b
  size: {k}
""", """property name 1 1
object settings 2 7
property debug 3 3 settings
array tags 4 6 settings
property size 7 7 settings"""),
    "x14_toml": ("toml", """name = "{n}"

[settings]
debug = false
size = {k}
tags = [
  "a",
]

[settings.theme]
color = "{n}"
""", """property name 1 1
object settings 3 8
property debug 4 4 settings
property size 5 5 settings
array tags 6 8 settings
object theme 10 11 settings
property color 11 11 theme"""),
    "x15_markdown": ("md", """---
title: {n}
---
# Head-{n}

Text-{k}
and more

## Part-{k}

```py
# no heading
```

- one
- two

> quote-{n}
""", """frontmatter frontmatter 1 3
property title 2 2 frontmatter
section Head-{n} 4 18
paragraph Text-{k} 6 7 Head-{n}
section Part-{k} 9 18 Head-{n}
code_block py 11 13 Part-{k}
list one 15 16 Part-{k}
blockquote quote-{n} 18 18 Part-{k}"""),
}

_N, _K = "replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING)", "CAST(p_partkey % 97 AS STRING)"
_WHAT = ("file", "what", "kind", "name", "first", "last", "owner")


def _filled(template: str) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{n}"), F.expr(_N)), F.lit("{k}"), F.expr(_K))


#: Files that one task parses; ``part`` is small on disk, so its splits are too few for the work that a row makes.
FILES_PER_TASK = 5_000


def _sources(s: SparkSession, d: str, extension: str, template: str) -> DataFrame:
    part = P.table(s, d, "part").select("p_partkey", "p_name")
    part = part.repartition(max(1, -(-part.count() // FILES_PER_TASK)), "p_partkey")
    return part.select(F.concat(F.lit("src/f"), F.col("p_partkey"), F.lit("." + extension)).alias("file"), _filled(template).alias("text"))


def _expected(extension: str, told: str) -> str:
    rows = []
    for line in told.splitlines():
        w = line.split(" ")
        if w[0] == ">":
            rows.append(("use", w[1], w[2], w[3], w[3], w[4] if len(w) > 4 else None))
        else:
            rows.append(("entity", w[0], w[1], w[2], w[3], w[4] if len(w) > 4 else None))
    values = ", ".join(f"('{a}', '{b}', '{c}', {x}, {y}, {repr(o) if o else 'NULL'})" for a, b, c, x, y, o in rows)
    fill = lambda c: f"replace(replace({c}, '{{n}}', {_N}), '{{k}}', {_K})"
    return f"SELECT 'src/f' || p_partkey || '.{extension}' AS file, what, kind, {fill('t.name')} AS name, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, {fill('owner')} AS owner FROM part, (VALUES {values}) t(what, kind, name, first, last, owner)"


def _extracted(extension: str, template: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        src = _sources(s, d, extension, template)
        return extract.items(src).where("what = 'entity' or kind <> 'type_annotation'").select(*_WHAT)

    return run


for _name, (_extension, _template, _told) in LANGUAGES.items():
    reg(_name, _expected(_extension, _told))(_extracted(_extension, _template))


# --- hashes and signatures of extracted entities

_PY = LANGUAGES["x02_python"][1]


@reg("h05_signatures", f"SELECT 'src/f' || p_partkey || '.py' AS file, t.kind, replace(replace(t.sig, '{{n}}', {_N}), '{{k}}', {_K}) AS sig, marker FROM part, (VALUES ('class', 'class T{{n}}:', 'dataclass'), ('method', 'def get_{{n}}(self, i: int) -> Optional[dict]:', ''), ('function', 'def _{{n}}(x):', '')) t(kind, sig, marker)")
def _(s, d):
    """H5, H6"""
    e = extract.entities(_sources(s, d, "py", _PY)).where("kind in ('class', 'method', 'function')")
    return e.select("file", "kind", "sig", F.array_join(F.coalesce("meta", F.array()), ",").alias("marker"))


@reg("h01_struct_hash", f"WITH t AS (SELECT p_partkey, string_split(replace(replace('{_PY.replace(chr(39), chr(39) * 2)}', '{{n}}', {_N}), '{{k}}', {_K}), chr(10)) AS l FROM part) SELECT 'src/f' || p_partkey || '.py' AS file, substr(sha256(array_to_string(l[13:14], chr(10))), 1, 16) AS struct_hash, substr(sha256(trim(l[14])), 1, 16) AS body_hash, substr(sha256(l[13]), 1, 16) AS sig_hash FROM t")
def _(s, d):
    """H1, H2, H4 as the extractor writes them"""
    return extract.entities(_sources(s, d, "py", _PY)).where("kind = 'function'").select("file", "struct_hash", "body_hash", "sig_hash")


# --- stores


_E_SHOWN = "file, name, kind, line_start, line_end, parent, sig, body_hash, sig_hash, struct_hash, CASE WHEN visibility <> 'private' THEN visibility END AS visibility"


@reg("s04_entity_lines", f"WITH {P.E} SELECT {_E_SHOWN} FROM E")
def _(s, d):
    """Written as JSON lines and reread"""
    path = fresh_path(s, "entities.jsonl")
    jsonl.write_entities(P.entities(s, d), path)
    return jsonl.read_entities(s, path).select(*(c.split(" AS ")[-1].strip() for c in _E_SHOWN.split(", ")))


@reg("s05_reference_lines", f"WITH {P.R} SELECT file, caller, name, kind, line FROM R")
def _(s, d):
    """S5, K1"""
    path = fresh_path(s, "refs.jsonl")
    jsonl.write_refs(P.refs(s, d), path)
    return jsonl.read_refs(s, path).select("file", "caller", "name", "kind", "line")


@reg("k05_hits_json", f"WITH {P.E} SELECT file, name, kind, line_start, line_end, parent, sig, visibility FROM E")
def _(s, d):
    """K5: one JSON document a row, parsed again"""
    schema = "file string, name string, kind string, line_start long, line_end long, parent string, sig string, visibility string"
    return jsonl.hits_json(P.entities(s, d)).select(F.from_json("value", schema).alias("v")).select("v.*")


_FEW = "SELECT file, CAST(1.0e0 / (1 + strlen(file)) AS DOUBLE) AS rank FROM (SELECT DISTINCT file FROM E)"


@reg("s08_rank_manifest", f"WITH {P.E} SELECT file, round(rank, 6) AS rank FROM ({_FEW})")
def _(s, d):
    """The manifest is one local file of a row for each file of a tree, as a tool keeps it"""
    rows = P.entities(s, d).select("file").distinct().select("file", (F.lit(1.0) / (1 + F.octet_length("file"))).alias("rank"))
    path = os.path.join(tempfile.mkdtemp(prefix="symloom-manifest-"), "rank.json")
    jsonl.write_manifest(path, {"version": 1}, "ranks", {r["file"]: r["rank"] for r in rows.collect()})
    return jsonl.read_ranks(s, "file://" + path).select("file", F.round("rank", 6).alias("rank"))


@reg("s09_pair_manifest", "SELECT n_name AS a, r_name AS b, round(0.5e0 + n_nationkey / 100.0e0, 6) AS weight, CAST(n_nationkey AS BIGINT) AS support FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    """S9, K3"""
    rows = P.table(s, d, "nation").join(P.table(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", "r_name", "n_nationkey")
    path = os.path.join(tempfile.mkdtemp(prefix="symloom-manifest-"), "cochange.json")
    jsonl.write_manifest(path, {"version": 1}, "pairs", [{"a": r[0], "b": r[1], "weight": 0.5 + r[2] / 100, "support": r[2]} for r in rows.collect()])
    return jsonl.read_pairs(s, "file://" + path).withColumn("weight", F.round("weight", 6))


@reg("s11_log", "SELECT DISTINCT CAST(l_orderkey AS STRING) AS commit, 'p' || l_partkey AS file FROM lineitem")
def _(s, d):
    """Orders as a stored log, a marker line and a line for each part"""
    rows = P.table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    width = F.lit(1_000_000_000).cast("long")
    marks = rows.select("l_orderkey").distinct().select((F.col("l_orderkey") * width).alias("position"), F.concat(F.lit("---"), "l_orderkey").alias("value"))
    files = rows.select((F.col("l_orderkey") * width + F.col("l_partkey") + 1).alias("position"), F.concat(F.lit(" p"), "l_partkey").alias("value"))
    return git.log_lines(marks.unionByName(files))


# --- scalars


@reg("sc02_qualified_tail", f"WITH {P.E}, q AS (SELECT seq, CASE seq % 3 WHEN 0 THEN name WHEN 1 THEN parent || '::' || name ELSE 'crate::m.x::' || name END AS q FROM E) SELECT seq, CASE WHEN contains(q, '::') THEN regexp_extract(q, '([^:]*)$', 1) END AS tail FROM q")
def _(s, d):
    q = F.expr("CASE seq % 3 WHEN 0 THEN name WHEN 1 THEN parent || '::' || name ELSE 'crate::m.x::' || name END")
    return P.entities(s, d).select("seq", S.qualified_tail(q).alias("tail"))


@reg("sc12_truncated", "SELECT page_id, CASE WHEN length(url) > 20 THEN url[1:20] || '...' ELSE url END AS short FROM pages")
def _(s, d):
    return P.table(s, d, "pages").select("page_id", S.truncate(F.col("url"), 20).alias("short"))


@reg("sc13_tidy_parens", f"WITH {P.E} SELECT seq, CASE WHEN seq % 2 = 0 THEN name || '(a, ' || kind || ')' ELSE name || '()' END AS sig FROM E")
def _(s, d):
    raw = F.expr("CASE WHEN seq % 2 = 0 THEN name || '( a, ' || kind || ', )' ELSE name || '( )' END")
    return P.entities(s, d).select("seq", S.tidy_parens(raw).alias("sig"))


@reg("sc11_predicates", r"SELECT event_id, regexp_full_match(v, '-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?|\.[0-9]+') AS number, regexp_full_match(t, '[A-Za-z0-9_.]+') AS identifier FROM (SELECT event_id, CAST(event_id % 1000 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '.5' ELSE 'x' END AS v, event_type || CASE WHEN event_id % 2 = 0 THEN '.a_1' ELSE ' b' END AS t FROM events)")
def _(s, d):
    v = F.expr("cast(event_id % 1000 as string) || CASE WHEN event_id % 2 = 0 THEN '.5' ELSE 'x' END")
    t = F.expr("event_type || CASE WHEN event_id % 2 = 0 THEN '.a_1' ELSE ' b' END")
    return P.table(s, d, "events").select("event_id", S.is_number(v).alias("number"), S.is_identifier(t).alias("identifier"))


@reg("sc20_kinds", f"WITH {P.E} SELECT seq, CASE k WHEN 'trait_impl' THEN 'impl' WHEN 'field' THEN 'property' WHEN 'procedure' THEN 'function' ELSE k END AS kind FROM (SELECT seq, CASE seq % 5 WHEN 0 THEN 'trait_impl' WHEN 1 THEN 'field' WHEN 2 THEN 'procedure' ELSE kind END AS k FROM E)")
def _(s, d):
    k = F.expr("CASE seq % 5 WHEN 0 THEN 'trait_impl' WHEN 1 THEN 'field' WHEN 2 THEN 'procedure' ELSE kind END")
    return P.entities(s, d).select("seq", S.normal_kind(k).alias("kind"))


@reg("v06_name_similarity", f"""WITH RECURSIVE {P.E}, p AS (SELECT e.seq, e.name AS a, f.name AS b FROM E e JOIN E f ON f.seq = e.seq + 1),
lc AS (SELECT seq, a, b, 0 AS i, (CAST(1 AS BIGINT) << length(a)) - 1 AS v FROM p UNION ALL SELECT seq, a, b, i + 1, ((v + (v & m)) | (v - (v & m))) & ((CAST(1 AS BIGINT) << length(a)) - 1)
FROM (SELECT *, CAST(list_sum(list_transform(range(length(a)), lambda k: CASE WHEN a[k + 1] = b[i + 1] THEN CAST(1 AS BIGINT) << k ELSE 0 END)) AS BIGINT) AS m FROM lc WHERE i < length(b)))
SELECT seq, CASE WHEN a = b THEN 1.0e0 ELSE round(2.0e0 * (length(a) - bit_count(v)) / (length(a) + length(b)), 5) END AS similarity FROM lc WHERE i = length(b)""")
def _(s, d):
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([textdiff.name_similarity(x, y) for x, y in zip(a, b)])

    e = P.entities(s, d).select("seq", "name")
    p = e.join(e.select((F.col("seq") - 1).alias("seq"), F.col("name").alias("b")), "seq")
    return p.select("seq", F.round(f("name", "b"), 5).alias("similarity"))


@reg("v13_entity_text", "SELECT doc_id, sha256(array_to_string(l[2:3], chr(10))) AS text FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL AND text <> '')")
def _(s, d):
    src = P.table(s, d, "documents").where("text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("file"), F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))
    at = F.struct("file", F.lit(2).cast("long").alias("line_start"), F.lit(3).cast("long").alias("line_end"))
    rows = src.select(at.alias("old"), at.alias("new"), F.lit(False).alias("sig_changed"), F.lit(True).alias("body_changed"), F.lit("modified").alias("change"))
    return diff.with_snippets(rows, src, src).select(F.col("new.file").cast("long").alias("doc_id"), F.sha2("snippet.base", 256).alias("text"))


@reg("q11_explore_cap", "SELECT p_partkey, greatest(1, p_partkey // greatest(1, p_size % 7)) AS cap FROM part")
def _(s, d):
    rows = P.table(s, d, "part").select("p_partkey", "p_size")

    def run(batches):
        for b in batches:
            yield b.assign(cap=[query.explore_cap(int(n), int(k) % 7) for n, k in zip(b["p_partkey"], b["p_size"])])[["p_partkey", "cap"]]

    return rows.mapInPandas(run, "p_partkey long, cap long")
