"""What is written and moved: nothing nobody reads, and no row more often than needed."""

from test_import import FILES, NOW, bundle, write

from furlong.plans import features, ingest, jobs, predictions
from furlong.sources import star_schema
from furlong.sources.scoring_config import BUILT_IN
from furlong.sources.store import Store

CONFIGS = tuple(BUILT_IN.values())
AT = "1999-01-01"


def exchanges(rows, *names):
    """How many hash exchanges of the plan deal rows by exactly these columns."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    found = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    return sum([part.split("#")[0].strip() for part in line.split(", ") if "#" in part] == list(names) for line in found)


def test_only_tables_asked_for_are_derived(spark, small):
    asked = []

    def stage(name, build):
        asked.append(name)
        return build()

    star = star_schema.Star(spark, small, stage=stage)
    assert star.races.columns and asked == ["races"]
    assert star.entries.columns and star.results.columns and asked == ["races", "lines"]


def test_predictions_move_once_for_all_versions_and_keep_no_texts(spark, small):
    tables = star_schema.load(spark, small)
    ranked = predictions.ranked_rows(tables, features.feature_rows(tables, [AT]), AT, CONFIGS)
    assert "score_components" not in ranked.columns
    assert exchanges(ranked, "race_id", "model_version") == 0
    whole = predictions.with_components(ranked, CONFIGS)
    assert "adjustments" not in whole.columns and whole.count() == len(CONFIGS) * features.targets_as_of(tables, AT).count()
    row = whole.filter("size(score_components.components) > 3").first()
    total = row["score_components"]["base_score"] + sum(item["adjustment"] for item in row["score_components"]["components"])
    assert abs(min(100, max(0, total)) - float(row["prediction_score"])) < 0.01


def test_resolving_moves_and_stages_no_made_ids(spark, tmp_path):
    from furlong.sources.csv_bundle import BUNDLE, read_bundle

    read = read_bundle(spark, bundle(tmp_path, "ids"))
    valid = {table: ingest.valid_rows(ingest.validate(read[table], table)) for table in BUNDLE}
    staged = {}
    resolved, errors = ingest.resolve(valid, lambda name, rows: staged.setdefault(name, rows))
    for rows in staged.values():
        assert not {"entry_id", "race_id", "horse_id", "result_id"} & set(rows.columns)
    races = {row["race_id"] for row in resolved["races"].collect()}
    entries = {row["entry_id"]: row["race_id"] for row in resolved["race_entries"].collect()}
    assert len(entries) == 4 and set(entries.values()) == races and errors.count() == 0
    assert {row["entry_id"] for row in resolved["race_results"].collect()} == set(entries)


def test_failed_rows_of_a_table_in_several_files_all_count(spark, tmp_path):
    """Row numbers start anew in every file."""
    folder = bundle(tmp_path, "parts")
    (tmp_path / "parts" / "results").mkdir()
    header, lines = FILES["race_results"]
    for nth, line in enumerate(lines[:2]):
        write(tmp_path / "parts" / "results" / f"{nth}.csv", header + line.replace("finished", "flew") + "\n")
    store = Store(spark, str(tmp_path / "store"))
    done = jobs.import_bundle(store, folder, NOW, dry_run=True, files={"race_results": "results"}, partial=True)
    assert done["failed"] == 2
