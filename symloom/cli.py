"""Command line: ``python -m symloom.cli COMMAND ...`` over the tree in --root. Text by default, --json for JSON, --markdown for
Markdown where a command has a report.

Exit codes: 2 for a symbol that isn't found, 3 for a comparison that can't be made, 1 for other errors.
"""

from __future__ import annotations

import argparse
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import diff, graph, query, review
from symloom.plans import render, report
from symloom.project import Project, diff_files
from symloom.sources import git
from symloom.storage import stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symloom")
    p.add_argument("--root", default=".")
    p.add_argument("--json", action="store_true")
    p.add_argument("--markdown", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options: object) -> None:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            if isinstance(v, bool):
                c.add_argument(flag, action="store_true", default=v)
            else:
                c.add_argument(flag, default=v, type=type(v) if v is not None else str)

    add("index", no_rank=False)
    add("callers", "name", kind=None, limit=0, group_by=None)
    add("callees", "name", kind=None, limit=0, group_by=None)
    add("symbols", "file", kind=None, limit=0, depth=0)
    add("children", "file", "parent", kind=None, limit=0)
    add("search", "q", scope="symbol", kind=None, path=None, limit=20)
    add("explore", path=None, max_entries=200)
    add("outline", path=None)
    add("where", "symbol", include_tests=False)
    add("blast", "symbol", depth=10)
    add("duplicates", min_lines=3, max_group=0)
    add("query", "sql", max_cell_width=80)
    add("cochange", commits=500, min_support=2, max_files=30)
    add("context", "symbol", tokens=1500, depth=10)
    add("map", tokens=4000, depth=5, focus=None, write=False)
    add("diff", "spec", context=0, lines=False, no_color=False, group=False, no_callers=False)
    add("files", "old", "new", context=0, lines=False, no_color=False, group=False)
    add("review", "spec", top=5)
    add("benchmark", spec="HEAD~1", symbol=None)
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[int, str]:
    """The exit code and what to print."""
    p = Project(spark, args.root)
    show = render.to_json if args.json else render.table
    c = args.command
    if c == "index":
        p.index(rank=not args.no_rank)
        e, r = p.tables()
        return 0, f"{e.count()} entities, {r.count()} references"
    if c in ("callers", "callees"):
        rows = getattr(p, c)(args.name, args.kind, args.limit)
        rows = query.refs_grouped(rows, args.group_by) if args.group_by else rows
        if rows.isEmpty():
            near = [r["name"] for r in p.suggest(args.name).collect()]
            return 0, "[]" if args.json else "nothing found" + (f"; near names: {', '.join(near)}" if near else "")
        return 0, show(rows)
    if c == "symbols":
        return 0, show(p.symbols(args.file, args.kind, args.limit, args.depth))
    if c == "children":
        return 0, show(p.children(args.file, args.parent, args.kind, args.limit))
    if c == "search":
        return 0, show(p.search(args.q, args.scope, args.kind, args.path, args.limit))
    if c == "explore":
        return 0, "\n\n".join(map(show, p.explore(args.path, args.max_entries)))
    if c == "outline":
        return 0, show(p.outline(args.path)) if args.json else report.outline_text(p.outline(args.path))
    if c == "where":
        rows = p.where(args.symbol, args.include_tests)
        return 0, show(rows) if args.json else report.where_text(args.symbol, rows)
    if c == "blast":
        told = report.blast_document(args.symbol, *p.blast(args.symbol, args.depth))
        return (2, f"{args.symbol} isn't defined here") if told is None else (0, report.to_json(told) if args.json else report.blast_markdown(told))
    if c == "duplicates":
        rows = p.duplicates(args.min_lines, args.max_group)
        return 0, show(rows) if args.json else report.duplicates_text(rows, graph.duplicates_totals(p.tables()[0], args.min_lines, args.max_group))
    if c == "query":
        rows: DataFrame = p.sql(args.sql)
        return 0, render.to_json(rows) if args.json else render.markdown(rows, args.max_cell_width)
    if c == "cochange":
        return 0, show(p.cochange(args.commits, args.min_support, args.max_files))
    if c == "context":
        bundle = p.context(args.symbol, args.tokens, args.depth)
        return (2, f"{args.symbol} isn't defined here") if bundle is None else (0, report.to_json(bundle, True) if args.json else report.context_markdown(bundle))
    if c == "map":
        options = {"budget": args.tokens, "depth": args.depth, "focus": args.focus}
        return 0, p.write_map(**options) if args.write else render.map_markdown(*p.map(**options))
    if c == "benchmark":
        rows, median = p.benchmark(args.spec, args.symbol)
        return 0, report.to_json({"queries": rows, "median_ratio": median}) if args.json else report.benchmark_text(rows, median)
    try:
        if c in ("diff", "files"):
            context = args.context if args.lines or args.context else None
            changes = p.diff(args.spec, context) if c == "diff" else diff_files(spark, args.old, args.new, context)
            base, head = git.parse_spec(args.spec) if c == "diff" else (args.old, args.new)
            shown, pats = stored(diff.visible(changes), "changes"), stored(diff.patterns(changes), "patterns")
            callers = diff.breaking_callers(shown, p.tables()[1]) if c == "diff" and not args.no_callers and p.indexed() else None
            told = report.diff_document(shown, pats, base, head, callers, diff.groups(shown, pats) if args.group else None)
            return 0, report.to_json(told) if args.json else report.diff_markdown(told, args.lines) if args.markdown else report.diff_terminal(told, args.lines, not args.no_color and sys.stdout.isatty())
        changes, misses = p.review(args.spec)
        changes = stored(changes, "changes")
        order = [F.round("impact", 12).desc(), "file", "line", "name", "change"]
        told = report.review_document(changes.orderBy(*order), review.file_deltas(changes), misses, args.spec, args.top)
        return 0, report.to_json(told) if args.json else report.review_markdown(told)
    except (subprocess.CalledProcessError, OSError, ValueError) as error:  # a ref, a file or a repository that isn't there
        return 3, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("symloom").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        code, text = run(args, spark)
    except ValueError as error:
        code, text = 1, str(error)
    print(text, file=sys.stdout if code == 0 else sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
