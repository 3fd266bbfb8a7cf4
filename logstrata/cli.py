"""Command line: ``python -m logstrata.cli VERB ...`` prints one JSON result."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from logstrata.operators import filters
from logstrata.plans import investigation, scenario, tools, views
from logstrata.plans.layouts import segmented
from logstrata.plans.runtime import plugged
from logstrata.sources import sinks
from logstrata.sources.lines import digests, resolve_paths
from logstrata.sources.registry import build_source, names_of_providers


#: Rows of a list that are printed; the answer says how many there are.
LISTED = 128


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logstrata")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in ("probe", "survey", "probe-format", "sample", "peek"):
        verbs.add_parser(name).add_argument("path")
    verbs.choices["sample"].add_argument("--strategy", default="head-tail")
    verbs.choices["sample"].add_argument("--count", type=int, default=10)
    search = verbs.add_parser("search")
    search.add_argument("path")
    search.add_argument("query")
    search.add_argument("--regex", action="store_true")
    search.add_argument("--fold", action="store_true")
    for option in ("--last", "--since", "--until"):
        search.add_argument(option)
    expand = verbs.add_parser("expand")
    expand.add_argument("path")
    expand.add_argument("line", type=int)
    expand.add_argument("--before", type=int, default=3)
    expand.add_argument("--after", type=int, default=3)
    many = verbs.add_parser("expand-many")
    many.add_argument("path")
    many.add_argument("result")
    many.add_argument("refs", nargs="+")
    for name in ("verify", "run", "explain"):
        verbs.add_parser(name).add_argument("document")
    verbs.choices["run"].add_argument("--output")
    verbs.choices["run"].add_argument("--allow-live", action="store_true")
    verbs.choices["run"].add_argument("--allow-actions", action="store_true")
    chosen = verbs.add_parser("filter")
    chosen.add_argument("path")
    chosen.add_argument("pattern")
    chosen.add_argument("--output")
    for option in ("--last", "--since", "--until", "--pid"):
        chosen.add_argument(option)
    for option in ("--line-from", "--line-to", "--tail-lines"):
        chosen.add_argument(option, type=int)
    for name in ("segment", "source"):
        verbs.add_parser(name).add_argument("path")
    for name in ("filter", "segment"):
        verbs.choices[name].add_argument("--segmenter", default="auto")
    verbs.add_parser("plugin")
    state = verbs.add_parser("investigation")
    state.add_argument("action", choices=["create", "show", "hypothesis", "stop", "gaps", "timeline"])
    state.add_argument("state")
    state.add_argument("text", nargs="?", default="")
    return top


def _investigate(spark: SparkSession, args: argparse.Namespace) -> object:
    if args.action == "create":
        state = investigation.create(args.text)
        investigation.write_json(args.state, state)
        return state
    if args.action == "hypothesis":
        with investigation.opened(args.state) as state:
            return {"id": investigation.add_hypothesis(state, args.text)}
    if args.action == "stop":
        with investigation.opened(args.state) as state:
            investigation.stop(state, args.text or "completed")
            return state
    state = json.loads(Path(args.state).read_text(encoding="utf-8"))
    if args.action == "show":
        return state
    parts = investigation.tables(spark, state)
    rows = investigation.gaps(parts) if args.action == "gaps" else investigation.entries(parts)
    shown, total = [r.asDict() for r in rows.limit(LISTED).collect()], rows.count()
    return {"rows": shown, "total": total, "status": "partial" if total > len(shown) else "ok"}


def _filter(spark: SparkSession, args: argparse.Namespace) -> dict[str, object]:
    """Records that match, written if a folder is named; the answer counts them and says what was searched."""
    records, kind = segmented(build_source(spark, {"path": args.path}), args.segmenter)
    scope = {k: getattr(args, k) for k in ("last", "since", "until", "pid", "line_from", "line_to", "tail_lines")}
    found = scenario.filtered(records, scope | {"grep": args.pattern})
    rows = [r.asDict() for r in filters.summary(found).orderBy("source_id").limit(LISTED).collect()]
    if args.output:
        sinks.write_records(filters.hits(found), f"{args.output}/records")
        sinks.write_hits(filters.hits(found), f"{args.output}/hits")
    return {"status": "ok" if any(r["matched_records"] for r in rows) else "no_match", "scope": views.scope_text(scope), "segmenter": kind, "sources": rows}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("logstrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    match args.verb:
        case "probe":
            result = tools.probe(spark, args.path)
        case "survey":
            result = tools.survey(spark, args.path)
        case "probe-format":
            result = tools.probe_format(spark, args.path)
        case "sample":
            result = tools.sample(spark, args.path, strategy=args.strategy, count=args.count)
        case "peek":
            result = tools.peek(spark, args.path)
        case "search":
            result = tools.search(spark, args.path, args.query, regex=args.regex, fold=args.fold, span=args.last, since=args.since, until=args.until)
        case "expand":
            result = tools.expand(spark, args.path, args.line, before=args.before, after=args.after)
        case "expand-many":
            result = tools.expand_many(spark, json.loads(Path(args.result).read_text(encoding="utf-8")), args.path, args.refs)
        case "verify":
            result = tools.verify(spark, json.loads(Path(args.document).read_text(encoding="utf-8")))
        case "filter":
            result = _filter(spark, args)
        case "segment":
            records, kind = segmented(build_source(spark, {"path": args.path}), args.segmenter)
            result = {"segmenter": kind, "records": records.count()}
        case "source":
            files = digests(spark, resolve_paths(spark, args.path))
            result = {"files": [r.asDict() for r in files.orderBy("path").limit(LISTED).collect()], "total": files.count()}
        case "plugin":
            given = plugged()
            result = {"presets": sorted(given.presets), "assertions": sorted(given.assertions), "outputters": sorted(given.outputters), "sources": sorted(names_of_providers())}
        case "run":
            granted = replace(plugged(), allow_live=args.allow_live, allow_actions=args.allow_actions)
            result = scenario.run(spark, scenario.load(args.document), args.output, granted)
        case "explain":
            result = scenario.explain(scenario.load(args.document), plugged())
        case _:
            result = _investigate(spark, args)
    print(json.dumps(result, ensure_ascii=False, default=str))
    return int(isinstance(result, dict) and result.get("status") == "error")


if __name__ == "__main__":
    sys.exit(main())
