"""Reports over collected results (K4, K9, K10): Markdown, terminal text and one JSON document for each command.

What to report is worked out by DataFrames; here it is only read and put into words.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from symloom.operators import diff
from symloom.plans.render import SIGNS

_COLOURS = {"added": 32, "removed": 31, "modified": 33, "renamed": 36, "moved": 36, "formatting_only": 90}
_LINE = {"added": "+", "removed": "-", "context": " ", "separator": " "}
_COUNTED = ("added", "removed", "modified", "renamed", "formatting_only")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def diff_document(shown: DataFrame, pats: DataFrame, base: str, head: str, callers: DataFrame | None = None, groups: DataFrame | None = None) -> dict:
    """One diff as a document: meta, summary, breaking, patterns, moves, files, and groups if asked for."""
    keep = [c for c in ("lines", "details", "token_changes", "snippet") if c in shown.columns]
    at = _rows(shown.where("not cross_file_move").select("file", "change", "kind", "name", "line", "old_name", "old_file", "sig_changed", "body_changed", "breaking", "reason", *keep).orderBy("file", "line", "name"))
    files: dict[str, dict] = {}
    for r in at:
        own = files.setdefault(r.pop("file"), {"entities": [], **dict.fromkeys(_COUNTED, 0)})
        own[r["change"]] += 1
        own["entities"].append(r)
    patterns = _rows(pats)
    bad = _rows(callers) if callers is not None else _rows(shown.where("breaking").select("name", "kind", "file", "line", "reason").orderBy("file", "line", "name"))
    summary = diff.report(shown, pats).first().asDict()
    sections = [(f, [e["name"] for e in s["entities"] if e["change"] != "formatting_only"]) for f, s in files.items()]
    summary |= {"has_breaking": summary["breaking"] > 0, "summary_line": diff.summary_line(patterns, bad, sections)}
    out = {"meta": {"base_ref": base, "head_ref": head}, "summary": summary, "breaking": bad, "patterns": patterns, "moves": _rows(diff.moves(shown)), "files": [{"file": f, **s} for f, s in files.items()]}
    return out | ({"groups": _rows(groups)} if groups is not None else {})


def to_json(document: dict | list, pretty: bool = False) -> str:
    return json.dumps(document, default=str, ensure_ascii=False, indent=1 if pretty else None)


def _spec(d: dict) -> str:
    m = d["meta"]
    return m["base_ref"] if m["head_ref"] in ("HEAD", "") else f"{m['base_ref']}..{m['head_ref']}"


def _many(n: int, word: str) -> str:
    return f"{n} {word}" + ("" if n == 1 else "s")


def _was(e: dict) -> str:
    return f" (was {e['old_name']})" if e["old_name"] else f" (from {e['old_file']})" if e["old_file"] else ""


def _outside(b: dict) -> str:
    if "external" not in b:
        return ""
    names = ", ".join(f"{x['file']}:{x['line']}" for x in b["external"][:3])
    more = f" +{len(b['external']) - 3} more" if len(b["external"]) > 3 else ""
    return f" — {_many(b['callers_in_diff'], 'caller')} in this change, {len(b['external'])} outside" + (f": {names}{more}" if names else "")


def diff_markdown(d: dict, lines: bool = True) -> str:
    """K10 for a review page: a head, patterns, moves, then a section for each file."""
    s = d["summary"]
    if not d["files"] and not d["moves"] and not d["patterns"]:
        return f"`{_spec(d)}`: no structural changes\n"
    out = [f"**diff** `{_spec(d)}`: {_many(s['files_changed'], 'file')}" + (f", **{s['breaking']} breaking**" if s["has_breaking"] else "")]
    out += ["", f"_{s['summary_line']}_"] if s["summary_line"] else []
    out += ["", "---"]
    if d["breaking"]:
        out += ["", "**breaking**", ""] + [f"- `{b['name']}` in `{b['file']}:{b['line']}`: {b['reason']}{_outside(b)}" for b in d["breaking"]]
    if d["patterns"]:
        out += ["", "**patterns**", ""] + [f"- `{p['base']}` {p['change']} in {_many(p['file_count'], 'file')}" for p in d["patterns"]]
    if d["moves"]:
        out += ["", "**moves**", ""] + [f"- `{m['name']}` `{m['from_file']}` → `{m['to_file']}`" for m in d["moves"]]
    if d.get("groups"):
        out += ["", "**groups**", ""] + [f"- {g['label']}" for g in d["groups"]]
    for f in d["files"]:
        out += ["", f"### `{f['file']}`", ""]
        for e in f["entities"]:
            out.append(f"- {SIGNS[e['change']]} `{e['name']}` _{e['kind']}_" + (f" :{e['line']}" if lines else "") + _was(e) + (f" **breaking**: {e['reason']}" if e["breaking"] else ""))
            out += [f"  - {x['description']}" for x in e.get("details") or ()]
            if e.get("lines"):
                out += ["", "  ```diff", *(f"  {_LINE[x['kind']]}{x['text']}" for x in e["lines"]), "  ```", ""]
    return "\n".join([*out, "", "---", "", s["natural_language"], ""])


def diff_terminal(d: dict, lines: bool = False, colour: bool = False) -> str:
    """K10 for a terminal; ``lines`` adds line numbers and changed lines."""
    paint = (lambda text, code: f"\033[{code}m{text}\033[0m") if colour else (lambda text, code: text)
    s = d["summary"]
    out = [s["natural_language"], *([s["summary_line"]] if s["summary_line"] else [])]
    if d["patterns"]:
        out += ["", paint("patterns", 2), *(f"  {p['base']} {p['change']} in {_many(p['file_count'], 'file')}" for p in d["patterns"])]
    if d["moves"]:
        out += ["", paint("moves", 2), *(f"  {m['name']}  {m['from_file']} => {m['to_file']}" for m in d["moves"])]
    if d.get("groups"):
        out += ["", paint("groups", 2), *(f"  {g['label']} ({g['entities']})" for g in d["groups"])]
    for f in d["files"]:
        out += ["", paint(f["file"], 1)]
        for e in f["entities"]:
            out.append(f"  {paint(SIGNS[e['change']], _COLOURS[e['change']])} {e['kind']} {e['name']}" + (f":{e['line']}" if lines else "") + _was(e) + (paint(f"  BREAKING: {e['reason']}", 31) if e["breaking"] else ""))
            out += [f"      {x['description']}" for x in (e.get("token_changes") or ())]
            if lines:
                out += [paint(f"      {_LINE[x['kind']]} {x['text']}", _COLOURS.get(x["kind"], 90)) for x in e.get("lines") or ()]
    out += ["", *(f"breaking: {b['name']} ({b['reason']}){_outside(b)}" for b in d["breaking"])] if d["breaking"] else []
    return "\n".join(out)


def blast_document(symbol: str, found: DataFrame, callers: DataFrame) -> dict | None:
    """The chosen definition, its impact, callers by the rank of their files, and other definitions."""
    rows = sorted(_rows(found), key=lambda r: r["place"])
    if not rows:
        return None
    top = _rows(callers)
    return {"symbol": symbol, "chosen": rows[0], "impact": rows[0]["blast_radius"], "callers": top, "skipped": top[0]["skipped"] if top else 0, "alternatives": rows[1:]}


def blast_markdown(d: dict) -> str:
    c, i = d["chosen"], d["impact"]
    out = [f"# `{d['symbol']}`", "", f"**{c['kind']}** in `{c['file']}`:{c['line_start']}-{c['line_end']}", ""]
    out += ["**Impact:** " + (f"{_many(i['direct_callers'], 'caller')} in {_many(i['direct_files'], 'file')}, {i['transitive_callers']} within three hops" if i else "not known, index first"), ""]
    if d["callers"]:
        out += [f"## Callers ({len(d['callers'])} of {len(d['callers']) + d['skipped']})", ""]
        out += [f"- `{r['file']}:{r['line']}` `{r['caller'] or '<top-level>'}` _{r['kind']}_ (rank {r['rank']:.4f})" for r in d["callers"]] + [""]
    if d["alternatives"]:
        out += ["## Other definitions", ""] + [f"- `{r['file']}`:{r['line_start']} {r['kind']}" + (f" in {r['parent']}" if r["parent"] else "") for r in d["alternatives"]] + [""]
    return "\n".join(out)


def context_markdown(bundle: dict) -> str:
    c = bundle["chosen"]
    out = [f"# `{c['name']}`", "", f"**{c['kind']}** in `{c['file']}`:{c['line_start']}-{c['line_end']}" + (f", part of `{c['parent']}`" if c["parent"] else ""), ""]
    out += ["```", c["sig"], "```", ""] if c["sig"] else []
    at = lambda r: f"- `{r['file']}:{r['line']}` "
    for key, head, tell in (
        ("callers", "Callers", lambda r: at(r) + f"`{r['caller'] or '<top-level>'}`"), ("callees", "Uses", lambda r: at(r) + f"`{r['name']}`"), ("types", "Types", lambda r: at(r) + f"`{r['name']}`"),
        ("overrides", "Same name elsewhere", lambda r: f"- `{r['file']}:{r['line_start']}` `{r['name']}`"), ("alternatives", "Other definitions", lambda r: f"- `{r['file']}:{r['line_start']}` {r['kind']}"),
    ):
        gone = bundle.get(f"{key}_skipped", 0)
        if bundle.get(key) or gone:
            out += [f"## {head}", "", *map(tell, bundle[key]), *([f"- _{gone} more left out_"] if gone else []), ""]
    return "\n".join(out)


def where_text(symbol: str, rows: DataFrame) -> str:
    got = _rows(rows)
    if not got:
        return f"{symbol} isn't defined here"
    tell = lambda r: f"{r['file']}:{r['line']}  {r['kind']} " + (f"{r['parent']}." if r["parent"] else "") + r["name"] + (f"  (+{r['overloads'] - 1} overloads)" if r["overloads"] > 1 else "") + (f"\n    {r['sig']}" if r["sig"] else "")
    return "\n".join([_many(len(got), "definition"), *map(tell, got)])


def outline_text(rows: DataFrame) -> str:
    out = []
    for r in _rows(rows):
        out += [f"{r['file']} ({r['n']})"] + [f"  {e['line']}" + (f"-{e['line_end']}" if e["line_end"] else "") + f"  {e['kind']} {e['name']}" for e in r["entries"]]
    return "\n".join(out)


def duplicates_text(rows: DataFrame, totals: DataFrame) -> str:
    t, out, last = totals.first(), [], None
    out.append(f"{_many(t['groups'], 'group')} of equal bodies, {t['total_clones']} members, {t['scanned']} entities looked at")
    for r in _rows(rows):
        if r["body_hash"] != last:
            out.append(f"\n{r['size']} x {_many(r['lines'], 'line')}  {r['body_hash']}")
            last = r["body_hash"]
        out.append(f"  {r['file']}:{r['line_start']}-{r['line_end']}  {r['kind']} " + (f"{r['parent']}." if r["parent"] else "") + r["name"])
    return "\n".join(out)


def review_document(changes: DataFrame, files: DataFrame, misses: DataFrame, spec: str, top: int = 5) -> dict:
    keep = ("change", "kind", "name", "old_name", "file", "line", "breaking", "reason", "rank", "impact", "direct_files", "direct_callers")
    rows = changes.select(*keep)
    return {"spec": spec, "summary": diff.summary(changes).first().asDict(), "top": _rows(rows.where("kind <> 'import'").limit(top)), "breaking": _rows(rows.where("breaking")), "files": _rows(files), "misses": _rows(misses)}


def review_markdown(d: dict) -> str:
    s = d["summary"]
    n = {k: v for k, v in s.items() if k != "has_breaking"}
    out = [f"# Review of `{d['spec']}`", "", f"{sum(n.values())} entities changed: " + (", ".join(f"{v} {k.replace('_', ' ')}" for k, v in n.items() if v) or "none") + ("; **breaking changes**" if s["has_breaking"] else ""), ""]
    tell = lambda e: f"- _{e['change']}_ {e['kind']} `{e['name']}`" + (f" (was `{e['old_name']}`)" if e["old_name"] else "") + f" in `{e['file']}:{e['line']}`" + (f" **{e['reason']}**" if e["breaking"] else "") + f" (rank {e['rank']:.4f}, {e['direct_files']} files, {e['direct_callers']} callers)"
    for head, rows in (("Most impact", d["top"]), ("Breaking", d["breaking"])):
        out += [f"## {head}", "", *map(tell, rows), ""] if rows else []
    if d["files"]:
        out += ["## Files", "", *(f"- `{f['file']}` {_many(f['changes'], 'change')}" + (f", {f['breaking']} breaking" if f["breaking"] else "") + f" (rank {f['rank']:.4f})" for f in d["files"]), ""]
    if d["misses"]:
        out += ["## Usually changed together, but not here", "", *(f"- `{m['expected_partner']}` with `{m['file']}` ({m['weight']:.2f}, {m['support']} times)" for m in d["misses"]), ""]
    return "\n".join(out)


def benchmark_text(rows: list[dict], median: float | None) -> str:
    out = ["| question | control | treatment | ratio |", "| --- | ---: | ---: | ---: |"]
    out += [f"| {r['name']} | {'skipped' if r['control'] is None else r['control']} | {r['treatment']} | {'' if r['control'] is None or not r['treatment'] else format(r['control'] / r['treatment'], '.1f')} |" for r in rows]
    return "\n".join([*out, "", f"median ratio {median:.1f}" if median is not None else "no ratio"])
