"""Text at the edge (K5-K10): small results as aligned tables, Markdown or JSON. Only these functions collect."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row

SIGNS = {"added": "+", "removed": "-", "modified": "~", "renamed": ">", "moved": "@", "formatting_only": "."}


def cell(value: object, width: int = 0) -> str:
    """SC21, SC12: null is empty, bytes are ``<blob>``; ``width`` 0 doesn't cut."""
    if value is None:
        return ""
    if isinstance(value, (bytes, bytearray)):
        return "<blob>"
    s = str(value).lower() if isinstance(value, bool) else json.dumps(value, default=_plain, ensure_ascii=False) if isinstance(value, (list, dict, Row)) else str(value)
    return s[: width - 1] + "…" if width and len(s) > width else s


def _plain(x: object) -> object:
    return x.asDict(True) if isinstance(x, Row) else str(x)


def markdown(df: DataFrame, width: int = 80) -> str:
    """K8"""
    rows = [[cell(v, width).replace("|", "\\|").replace("\n", " ") for v in r] for r in df.collect()]
    head = [f"| {' | '.join(df.columns)} |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + [f"| {' | '.join(r)} |" for r in rows])


def to_json(df: DataFrame, indent: int | None = None) -> str:
    """K6, K8"""
    return json.dumps([r.asDict(True) for r in df.collect()], default=str, indent=indent, ensure_ascii=False)


def table(df: DataFrame) -> str:
    """K7: aligned columns."""
    rows = [df.columns, *([cell(v) for v in r] for r in df.collect())]
    wide = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in rows)


def diff_text(sections: DataFrame, diffs: DataFrame) -> str:
    """A summary line and one line for each change, by file."""
    rows = diffs.orderBy("file", "line", "name").collect()
    n = {k: sum(r["change"] == k for r in rows) for k in SIGNS}
    told = [f"{v} {k.replace('_', ' ')}" for k, v in n.items() if v]
    bad = [r for r in rows if r["breaking"]]
    out = [(", ".join(told) or "no changes") + (f"; {len(bad)} breaking: {', '.join(r['name'] for r in bad[:2])}" + (f" +{len(bad) - 2} more" if len(bad) > 2 else "") if bad else "")]
    last = None
    for r in rows:
        if r["file"] != last:
            out.append(f"\n{r['file']}")
            last = r["file"]
        was = f" (was {r['old_name'] or r['old_file']})" if r["old_name"] or r["old_file"] else ""
        out.append(f"  {SIGNS[r['change']]} {r['kind']} {r['name']}:{r['line']}{was}" + (f"  BREAKING: {r['reason']}" if r["breaking"] else ""))
    return "\n".join(out)


def map_markdown(files: DataFrame, entities: DataFrame, subsystems: DataFrame) -> str:
    """K4, K9: the digest of ``digest.map_*`` as Markdown."""
    own: dict[str, list] = {}
    for r in entities.orderBy("file", "place").collect():
        own.setdefault(r["file"], []).append(r)
    out = ["# Map", "", "## Subsystems", ""]
    out += [f"- **{r['label']}** ({r['file_count']} files)" for r in subsystems.orderBy("file_count", ascending=False).collect()]
    out += ["", "## Files", ""]
    for f in files.collect():
        out.append(f"### {f['file']} ({f['score']:.4f})")
        out += [f"- `{r['sig'] or r['name']}` line {r['line_start']}" for r in own.get(f["file"], ())]
    return "\n".join(out)
