"""Command line: index, roam, refresh, profile-detect, version. Exit codes: 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rambleweave", description="Roam a collection of linked documents.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("source", help="a folder of Markdown files, or a block database (.db)")
        c.add_argument("--profile", help="a profile file")
        c.add_argument("--profile-name", help="a built-in profile")
        c.add_argument("--json", action="store_true")
        return c

    add("index", "statistics, types and dangling references")
    roam = add("roam", "the cluster around a query")
    roam.add_argument("query")
    for name, kind, default in (("top", int, 15), ("hops", int, 3), ("decay", float, 0.7), ("least", float, 0.1), ("alpha", float, 0.5), ("beta", float, 0.5)):
        roam.add_argument(f"--{name}", type=kind, default=default)
    refresh = add("refresh", "bring the store up to date")
    refresh.add_argument("--full", action="store_true")
    refresh.add_argument("--limit", type=int, default=50, help="changes shown")
    detect = sub.add_parser("profile-detect", help="a profile for a folder, from what is in it")
    detect.add_argument("source")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    from pyspark.sql import SparkSession

    from .api import Collection, load_source, refresh, to_json, to_markdown
    from .plans.ship import ship
    from .sources.blocks import is_block_db
    from .sources.markdown import detect_profile
    from .sources.profile import resolve_profile
    from .sources.store import Store, store_path

    spark = SparkSession.builder.appName("rambleweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    try:
        if args.command == "profile-detect":
            print(detect_profile(spark, args.source).dump())
            return 0
        profile = resolve_profile(args.profile, args.profile_name, None if is_block_db(args.source) else args.source)
        store = Store(spark, store_path(args.source))
        if args.command == "refresh":
            done, _ = refresh(spark, args.source, store, profile, full=args.full)
            counts = done.changes.summary.first().asDict() | {"reused": done.reused}
            shown = [r.asDict() for r in done.changes.changes.orderBy("kind", "id").limit(args.limit).collect()]
            print(json.dumps(counts | {"changes": shown}, ensure_ascii=False) if args.json else "\n".join([*(f"{k}: {v}" for k, v in counts.items()), *(f"{r['kind']} {r['id']} {','.join(r['fields'])}" for r in shown)]))
            return 0
        c = Collection(load_source(spark, args.source, profile, store), profile, store.renames())
        if args.command == "roam":
            out = c.roam(args.query, top=args.top, hops=args.hops, decay=args.decay, least=args.least, alpha=args.alpha, beta=args.beta)
            print(to_json(out) if args.json else to_markdown(out, args.query, args.source))
            return 0
        stats = c.stats().first().asDict()
        kinds = {r["type"]: r["n"] for r in c.graph.types().orderBy("type").collect()}
        lost = [r.asDict() for r in c.dangling().collect()]
        print(json.dumps(stats | {"types": kinds, "dangling": lost}, ensure_ascii=False) if args.json else "\n".join([*(f"{k}: {v}" for k, v in stats.items()), *(f"type {k}: {v}" for k, v in kinds.items()), *(f"dangling {r['source']} -> {r['target']}" for r in lost)]))
        return 0
    except (OSError, KeyError, ValueError) as e:
        print(f"rambleweave: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
