"""Command line: ``python -m gleaner discover FOLDER TERM...``, ``save``, ``generate``, ``check`` or ``run QUERY FOLDER``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from gleaner.session import get_session, table


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gleaner")
    sub = parser.add_subparsers(dest="command", required=True)
    d = sub.add_parser("discover", help="documents of recorded pages")
    d.add_argument("folder")
    d.add_argument("terms", nargs="*")
    d.add_argument("--latest", action="store_true")
    d.add_argument("--include-rejected", action="store_true")
    d.add_argument("--csv")
    g = sub.add_parser("generate", help="save a program that answers a goal, run it over recorded pages and keep its results")
    g.add_argument("folder")
    g.add_argument("start_url")
    g.add_argument("goal")
    g.add_argument("--code", required=True, help="file with the program's source (who writes it is not this engine's matter)")
    g.add_argument("--store", required=True)
    c = sub.add_parser("check", help="drift of saved programs, or of recorded snapshots where no store is given")
    c.add_argument("folder")
    c.add_argument("--store")
    r = sub.add_parser("run", help="a query of the catalogue")
    r.add_argument("query")
    r.add_argument("folder")
    a = parser.parse_args(argv)
    spark = get_session()
    from gleaner.engine import Engine
    from gleaner.plans import discover as plan
    from gleaner.plans import queries
    from gleaner.sources import sinks

    if a.command == "discover":
        docs = plan.discover(table(spark, a.folder, "pages"), F.array(*[F.lit(t) for t in a.terms]).cast("array<string>"), latest=a.latest, include_rejected=a.include_rejected)
        if a.csv:
            sinks.write_csv(docs, a.csv)
        else:
            docs.show(50, False)
        return 0
    if a.command == "generate":
        engine = Engine(spark, a.store)
        key = engine.save_program(a.start_url, a.goal, Path(a.code).read_text("utf-8"))
        engine.run_programs(table(spark, a.folder, "pages"))
        engine.results(key).show(50, False)
        return 0
    if a.command == "check":
        status = Engine(spark, a.store).check(table(spark, a.folder, "pages")) if a.store else queries.QUERIES["s5_drift"](spark, a.folder)
        status.show(50, False)
        return 2 if status.where("status in ('broken', 'shrank')").limit(1).count() else 0
    queries.QUERIES[a.query](spark, a.folder).show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
