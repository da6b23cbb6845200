"""Run every step on files or catalog tables: ``python -m pulse --help``, or spark-submit this file."""

from __future__ import annotations

import argparse
import datetime as dt

from pulse.plans.daily import run_daily
from pulse.session import build_session
from pulse.sinks.tables import PARTITIONED, PARTITIONED_SORTED, TableStore, export
from pulse.sources.countries import read_countries
from pulse.sources.feeds import read_events_feed, read_gkg_feed
from pulse.config import DEFAULTS


def main() -> None:
    parser = argparse.ArgumentParser(prog="pulse")
    parser.add_argument("--events", required=True, help="events feed: path or table")
    parser.add_argument("--gkg", required=True, help="knowledge-graph feed: path or table")
    parser.add_argument("--format", default="parquet", help="parquet, csv, tsv, json, table, ...")
    place = parser.add_mutually_exclusive_group(required=True)
    place.add_argument("--root", help="folder of the result tables")
    place.add_argument("--database", help="database of the result tables")
    parser.add_argument("--countries", help="CSV of the feed's country codes: code, iso2, region, valid_from")
    parser.add_argument("--as-of", type=dt.date.fromisoformat, help="day of the run, default today")
    parser.add_argument("--feed", help="also export the map feed as JSON lines to this path")
    args = parser.parse_args()

    spark = build_session()
    store = TableStore(spark, root=args.root, database=args.database)
    made = run_daily(
        read_events_feed(spark, args.events, args.format),
        read_gkg_feed(spark, args.gkg, args.format),
        store,
        as_of=args.as_of,
        country_dim=read_countries(spark, args.countries) if args.countries else None,
    )
    for name in sorted(n for n in PARTITIONED | PARTITIONED_SORTED if store.exists(n)):
        store.expire(name, args.as_of, DEFAULTS.retention_days)
    if args.feed:
        export(made["mood_map_feed"], args.feed)


if __name__ == "__main__":
    main()
