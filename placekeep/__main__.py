"""Command line: canned questions on a folder of tables.

python -m placekeep --data DIR [--format markdown|json|csv] QUESTION [ARGUMENT ...]
"""

from __future__ import annotations

import argparse

from placekeep import model
from placekeep.plans import cli
from placekeep.plans.render import QueryResult, render
from placekeep.session import session

QUESTIONS = {
    "summary": lambda p, a: cli.summary(p, a.state or ""),
    "city-summary": lambda p, a: cli.city_summary(p, a.state or "", a.limit, a.include_inactive),
    "locations": lambda p, a: cli.search_places(p, a.words[0], a.limit, a.include_inactive),
    "games": lambda p, a: cli.search_items(p, a.words[0], a.state or "", a.limit, a.include_inactive),
    "where": lambda p, a: cli.where_to_find(p, a.words[0], a.state or "", a.limit, a.state, a.include_inactive),
    "inventory": lambda p, a: cli.inventory(p, a.words[0], a.limit, a.include_inactive),
    "compare-locations": lambda p, a: cli.compare_places(p, cli.best_place(p, a.words[0]), cli.best_place(p, a.words[1]), a.limit),
    "rare": lambda p, a: cli.rare_items(p, int(a.words[0]) if a.words else 3, a.limit, a.state, a.include_inactive),
    "nearby": lambda p, a: cli.nearby(p, *map(float, a.words[:3]), a.limit, a.include_inactive),
    "inactive": lambda p, a: cli.inactive_places(p, a.limit, a.state),
    "verification-report": lambda p, a: cli.verification_report(p, a.limit, a.state),
    "source-coverage": lambda p, a: cli.source_coverage(p, a.limit, a.state),
    "duplicate-leads": lambda p, a: cli.duplicate_leads(cli.places(p), a.limit, a.state),
    "review-queue": lambda p, a: cli.review_queue(p, a.limit, a.state),
    "game-aliases": lambda p, a: cli.item_aliases(p, a.limit, a.words[0] if a.words else None),
}


def hoisted(argv: list[str]) -> list[str]:
    """Global flags may stand anywhere; they are moved to the front."""
    flags = {"--data": 1, "--format": 1, "--limit": 1, "--state": 1, "--include-inactive": 0}
    front, rest, i = [], [], 0
    while i < len(argv):
        name = argv[i].split("=")[0]
        take = flags.get(name, -1)
        n = 1 if take < 0 or "=" in argv[i] else 1 + take
        (rest if take < 0 else front).extend(argv[i : i + n])
        i += n
    return front + rest


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="placekeep")
    out.add_argument("--data", required=True)
    out.add_argument("--format", choices=("markdown", "json", "csv"), default="markdown")
    out.add_argument("--limit", type=int, default=25)
    out.add_argument("--state")
    out.add_argument("--include-inactive", action="store_true")
    out.add_argument("question", choices=sorted([*QUESTIONS, "sql"]))
    out.add_argument("words", nargs="*")
    return out


def main(argv: list[str]) -> str:
    a = parser().parse_args(hoisted(argv))
    spark = session()
    df = cli.raw_sql(spark, a.words[0], a.limit) if a.question == "sql" else QUESTIONS[a.question](model.bind(spark, a.data), a)
    return render(QueryResult(a.question, df), a.format, a.limit)


if __name__ == "__main__":
    import sys

    print(main(sys.argv[1:]))
