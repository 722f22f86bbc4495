"""Jobs from a shell: ``python -m furlong.commands import|features|predictions|evaluations --store FOLDER ...``.

Prints the counts as one JSON line; exit code 1 and the reason on standard error when a job fails.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from furlong.plans import jobs
from furlong.session import SETTINGS
from furlong.sources.store import Store


def instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise argparse.ArgumentTypeError("an instant needs an offset, as in 2026-06-19T00:00:00+09:00")
    return at


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="furlong", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("import", "features", "predictions", "evaluations", "clean"):
        one = commands.add_parser(name)
        one.add_argument("--store", required=True, help="root folder of the tables")
        if name == "clean":
            one.add_argument("--before", type=instant, required=True, help="what was replaced before this instant goes")
            continue
        one.add_argument("--dry-run", action="store_true")
        if name == "import":
            one.add_argument("--source-dir", required=True, help="folder of the CSV files")
            one.add_argument("--partial", action="store_true", help="leave out faulty rows and what refers to them")
            one.add_argument("--skip-older", action="store_true", help="leave stored rows alone that were observed later")
        if name in ("features", "predictions"):
            one.add_argument("--as-of-at", type=instant, help="an instant with an offset; now by default")
        if name == "predictions":
            one.add_argument("--model-version")
            one.add_argument("--config-dir", help="folder of configurations instead of the built-in ones")
        if name == "evaluations":
            one.add_argument("--prediction-run-id")
    return out


def run(arguments: argparse.Namespace, spark: SparkSession) -> dict[str, int]:
    store, now = Store(spark, arguments.store), datetime.now(timezone.utc)
    if arguments.command == "clean":
        return {"deleted": len(store.clean(arguments.before))}
    dry = arguments.dry_run
    if arguments.command == "import":
        return jobs.import_bundle(
            store, arguments.source_dir, now, dry_run=dry, partial=arguments.partial, skip_older=arguments.skip_older
        )
    if arguments.command == "features":
        return jobs.generate_features(store, arguments.as_of_at or now, now, dry_run=dry)
    if arguments.command == "predictions":
        return jobs.run_predictions(
            store, arguments.as_of_at or now, now, arguments.model_version, dry_run=dry, config_folder=arguments.config_dir
        )
    return jobs.run_evaluation(store, now, arguments.prediction_run_id, dry_run=dry)


def main(argv: Sequence[str] | None = None) -> int:
    arguments = parser().parse_args(argv)
    spark = SparkSession.builder.appName("furlong").config(map=SETTINGS).getOrCreate()
    try:
        print(json.dumps({"command": arguments.command, **run(arguments, spark)}))
    except Exception as failure:
        print(str(failure), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
