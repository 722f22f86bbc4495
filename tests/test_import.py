"""CSV reading, validation, and the jobs on a store."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from furlong import commands
from furlong.functions import scalars
from furlong.operators import merge
from furlong.operators.paging import page, page_totals
from furlong.plans import ingest, jobs
from furlong.sources import csv_bundle
from furlong.sources.store import StaleTable, Store

NOW = datetime(2026, 7, 5, tzinfo=timezone.utc)
AT = "2026-07-01T09:00:00+09:00"


def write(path, text):
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def read(spark, tmp_path, text):
    rows = csv_bundle.read_csv(spark, write(tmp_path / "x.csv", text)).drop("file").orderBy("row_number")
    return [tuple(r) for r in rows.collect()]


def test_row_numbers_and_quotes(spark, tmp_path):
    assert read(spark, tmp_path, "id,name\n1,A\n2,B\n") == [(2, "1", "A"), (3, "2", "B")]
    assert read(spark, tmp_path, 'id,name\n1,"A, ""quoted"" horse"\n') == [(2, "1", 'A, "quoted" horse')]


def test_blank_records_count_and_quoted_breaks_do_not(spark, tmp_path):
    text = '﻿id , name\r\n1,"A\r\nB"\r\n\r\n ,　\r\n4, 　D ,extra\r\n5\r\n'
    assert read(spark, tmp_path, text) == [(2, "1", "A\nB"), (5, "4", "D"), (6, "5", "")]


def test_odd_headers(spark, tmp_path):
    """A nameless column keeps its place, of equal names the last one counts."""
    found = csv_bundle.read_csv(spark, write(tmp_path / "h.csv", "id,,name,id\n1,X,A,2\n,Y,,\n")).orderBy("row_number").collect()
    assert [(r["name"], r["id"]) for r in found] == [("A", "2"), ("", "")]


def test_open_quote_rejects_the_file(spark, tmp_path):
    with pytest.raises(ValueError, match="not closed"):
        csv_bundle.read_csv(spark, write(tmp_path / "q.csv", 'id,name\n1,"A\n2,B\n'))


def test_two_jobs_on_one_store(spark, tmp_path):
    root = str(tmp_path / "shared")
    one, two = Store(spark, root), Store(spark, root)
    first, second = spark.range(1), spark.range(2)
    prepared = one.prepare({"left": first})
    two.replace({"right": second})
    one.switch(prepared)
    assert Store(spark, root).table("left", "id long").count() == 1 and Store(spark, root).table("right", "id long").count() == 2
    # Both read a table and replace it: the slower one must not undo the other.
    one.table("left", "id long"), two.table("left", "id long")
    one.replace({"left": second})
    with pytest.raises(StaleTable):
        two.replace({"left": first})
    assert Store(spark, root).table("left", "id long").count() == 2


def test_failed_runs_keep_their_reason(spark, store):
    row = {"batch_id": "x", "started_at": NOW}
    with pytest.raises(RuntimeError):
        jobs._run_history(store, "feature_batches", row, lambda: (_ for _ in ()).throw(RuntimeError("no " + "space " * 900)))
    kept = store.history("feature_batches").filter("batch_id = 'x'").first()
    assert kept["status"] == "failed" and kept["failure_reason"] == "no " + "space " * 900


def test_splits_are_joined(spark, tmp_path):
    """A small split size cuts inside quoted text; numbers and records stay right."""
    body = "".join(f'{n},"name ""{n}"",\nline two of {n}"\n' for n in range(2, 400))
    path = write(tmp_path / "big.csv", "id,name\n" + body)
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = csv_bundle.read_csv(spark, path)
        assert csv_bundle.read_lines(spark, path).select("split").distinct().count() > 5
        found = {r["row_number"]: (r["id"], r["name"]) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert found == {n: (str(n), f'name "{n}",\nline two of {n}') for n in range(2, 400)}


def test_ids(spark):
    import hashlib

    rows = spark.createDataFrame([(" given ", "S-1"), ("", "S-1"), (None, "S-2")], "id string, s string")
    ids = [r["i"] for r in rows.select(scalars.internal_id(F.col("id"), F.lit("p"), "horse", F.col("s")).alias("i")).collect()]
    digest = hashlib.sha256(b"p:horse:S-1").hexdigest()
    assert ids[0] == "given"
    assert ids[1].replace("-", "")[:12] == digest[:12] and ids[1][14] == "5" and ids[1][19] in "89ab"
    assert int(ids[1][19], 16) == (int(digest[16], 16) & 3) | 8
    assert ids[1] != ids[2]


def entry(**over):
    row = dict(
        row_number=2, id="", provider_code="p", available_at=AT, observed_at=AT, imported_at="", source_entry_id="E1",
        source_race_id="R1", source_horse_id="H1", source_jockey_id="J1", source_trainer_id="T1", frame_number="1",
        horse_number="1", assigned_weight="57.0", body_weight="", body_weight_diff="", status="running",
    )
    return {**row, **over}


def validate(spark, table, *rows):
    names = list(rows[0])
    schema = ", ".join(f"`{n}` " + ("bigint" if n == "row_number" else "string") for n in names)
    return ingest.validate(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema), table)


def failed(spark, **over):
    row = validate(spark, "race_entries", entry(**over)).first()
    return [issue.split(":")[0] for issue in row["issues"]]


def test_optional_values(spark):
    row = validate(spark, "race_entries", entry()).first()
    assert row["issues"] == [] and row["body_weight"] is None and row["body_weight_diff"] is None and row["id"] is None
    assert float(row["assigned_weight"]) == 57.0 and row["available_at"] is not None


@pytest.mark.parametrize(
    "over, columns",
    [
        ({"status": "unknown"}, ["status"]),
        ({"frame_number": "9", "horse_number": "0"}, ["frame_number", "horse_number"]),
        ({"frame_number": "", "body_weight": "-3"}, ["frame_number", "body_weight"]),
        ({"frame_number": "1.5"}, ["frame_number"]),
        ({"horse_number": "1e1"}, []),
        ({"body_weight_diff": "-4"}, []),
        ({"body_weight_diff": "x"}, ["body_weight_diff"]),
        ({"assigned_weight": "0"}, ["assigned_weight"]),
        ({"assigned_weight": "12345.6"}, ["assigned_weight"]),
        ({"id": "nope"}, ["id"]),
        ({"id": " 71000000-0000-4000-8000-000000000001 "}, []),
        ({"available_at": "2026-07-01T09:00:00"}, ["available_at"]),
        ({"imported_at": "2026-02-31T09:00:00Z"}, ["imported_at"]),
        ({"provider_code": "　"}, ["provider_code"]),
    ],
)
def test_rules(spark, over, columns):
    assert failed(spark, **over) == columns


def test_labels(spark):
    rows = spark.createDataFrame(
        [(93400, 480, 4, None, "did_not_finish"), (None, None, 1, 3, "finished"), (59960, 470, None, None, None),
         (33250, 462, -2, 1, "disqualified")],
        "ms int, w int, d int, p int, s string",
    ).select(
        scalars.race_time_label(F.col("ms")), scalars.body_weight_label(F.col("w"), F.col("d")),
        scalars.finish_label(F.col("p"), F.col("s")),
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("1:33.4", "480kg (+4)", "中止"), ("—", "未発表", "3着"), ("0:60.0", "470kg", "—"), ("0:33.3", "462kg (-2)", "失格"),
    ]


def test_merge(spark):
    old = spark.createDataFrame([("k1", "id1", "a"), ("k2", "id2", "b")], "k string, id string, v string")
    new = spark.createDataFrame(
        [("k2", "n2", "B", 1), ("k3", "n3", "c", 2), ("k3", "n4", "C", 3)], "k string, id string, v string, n int"
    )
    folded = merge.fold_repeats(new, ["k"], "n", ["id"]).drop("n")
    merged = sorted(map(tuple, merge.merge(old, folded, ["k"], ["id"]).collect()))
    assert merged == [("k1", "id1", "a"), ("k2", "id2", "B"), ("k3", "n3", "C")]
    assert tuple(merge.merge_counts(old, new, ["k"]).first()) == (1, 2, 0)
    ids = {r[0]: r[1] for r in merge.id_map(old, new, ["k"], "id", "n").collect()}
    assert ids == {"n2": "id2", "n3": "n3", "n4": "n3"}
    again = merge.merge(merge.merge(old, folded, ["k"], ["id"]), folded, ["k"], ["id"])
    assert sorted(map(tuple, again.collect())) == merged
    absent = merge.insert_absent(old, folded, ["k"])
    assert sorted(map(tuple, absent.collect())) == [("k1", "id1", "a"), ("k2", "id2", "b"), ("k3", "n3", "C")]


def test_pages(spark):
    rows = spark.range(25)
    assert [r["id"] for r in page(rows, [F.asc("id")], 3, 12).collect()] == [24]
    assert tuple(page_totals(rows, 12).first()) == (25, 3)
    assert tuple(page_totals(rows.filter("false"), 12).first()) == (0, 1)


FILES = {
    "races": (
        "id,provider_code,source_race_id,race_date,venue,race_number,name,scheduled_start_at,surface,distance_meters,"
        "weather,track_condition,status,available_at,observed_at,imported_at\n",
        [f",p,R{n},2026-06-{n:02d},東京,11,Race {n},2026-06-{n:02d}T15:40:00+09:00,芝,1600,,良,confirmed,{AT_EARLY},{AT_EARLY},"
         for n in (1, 20) for AT_EARLY in ["2026-05-01T09:00:00+09:00"]],
    ),
    "horses": ("id,provider_code,source_horse_id,name,birth_date,sex,color,available_at,observed_at,imported_at\n",
               [f",p,H{n},Horse {n},2022-03-12,male,,{AT},{AT}," for n in (1, 2)]),
    "jockeys": ("id,provider_code,source_jockey_id,name,available_at,observed_at,imported_at\n",
                [f",p,J1,Jockey,{AT},{AT},"]),
    "trainers": ("id,provider_code,source_trainer_id,name,affiliation,available_at,observed_at,imported_at\n",
                 [f",p,T1,Trainer,,{AT},{AT},"]),
    "race_entries": (
        "id,provider_code,source_entry_id,source_race_id,source_horse_id,source_jockey_id,source_trainer_id,frame_number,"
        "horse_number,assigned_weight,body_weight,body_weight_diff,status,available_at,observed_at,imported_at\n",
        [f",p,E{r}-{h},R{r},H{h},J1,T1,1,{h},55.0,480,4,running,2026-05-02T09:00:00+09:00,{AT}," for r in (1, 20) for h in (1, 2)],
    ),
    "race_results": (
        "id,provider_code,source_result_id,source_entry_id,finish_position,finish_status,finish_time_milliseconds,margin,"
        "final_odds,popularity,status,available_at,observed_at,imported_at\n",
        [f",p,Z{r}-{h},E{r}-{h},{h},finished,9{h}000,,3.8,{h},confirmed,2026-06-{r:02d}T17:00:00+09:00,{AT}," for r in (1, 20) for h in (1, 2)],
    ),
}


def bundle(tmp_path, name, **replaced):
    folder = tmp_path / name
    folder.mkdir()
    for table, (header, lines) in FILES.items():
        file_name, _, _ = csv_bundle.BUNDLE[table]
        write(folder / file_name, header + "\n".join(replaced.get(table, lines)) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A store, under settings that keep the planning of many tiny jobs short."""
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"}
    saved = {key: spark.conf.get(key) for key in quick}
    for key, value in quick.items():
        spark.conf.set(key, value)
    yield Store(spark, str(tmp_path_factory.mktemp("store")))
    for key, value in saved.items():
        spark.conf.set(key, value)


def ids(store, table, column):
    return sorted(r[column] for r in store.table(table).select(column).collect())


def test_imports_then_pipeline(spark, store, tmp_path):
    folder = bundle(tmp_path, "good")
    dry = jobs.import_bundle(store, folder, NOW, dry_run=True)
    assert (dry["read"], dry["valid"], dry["inserted"]) == (14, 14, 0) and not store.has("races")
    first = jobs.import_bundle(store, folder, NOW, batch_id="b1")
    assert (first["inserted"], first["updated"]) == (14, 0)
    kept = {t: ids(store, t, c) for t, c in (("races", "race_id"), ("entries", "entry_id"), ("results", "result_id"))}
    before = {t: sorted(map(str, store.table(t).collect())) for t in ("entries", "results")}

    # The same races under other source ids: natural keys match, stored ids stay, children follow them.
    races = [line.replace(",p,R", ",p,Q").replace("Race", "New") for line in FILES["races"][1]]
    entries = [line.replace(",R", ",Q") for line in FILES["race_entries"][1]]
    second = jobs.import_bundle(store, bundle(tmp_path, "renamed", races=races, race_entries=entries), NOW, batch_id="b2")
    assert (second["inserted"], second["updated"]) == (0, 14)
    assert kept == {t: ids(store, t, c) for t, c in (("races", "race_id"), ("entries", "entry_id"), ("results", "result_id"))}
    assert before == {t: sorted(map(str, store.table(t).collect())) for t in before}
    assert {r["name"] for r in store.table("races").collect()} == {"New 1", "New 20"}

    batches = {r["batch_id"]: r for r in store.history("import_batches").collect()}
    assert batches["b1"]["status"] == "succeeded" and batches["b1"]["provider_code"] == "p"
    assert [s["upserted"] for s in batches["b1"]["summary"]] == [2, 2, 1, 1, 4, 4]

    as_of = datetime(2026, 6, 19, tzinfo=timezone.utc)
    assert jobs.generate_features(store, as_of, NOW, dry_run=True)["inserted"] == 0
    made = jobs.generate_features(store, as_of, NOW)
    assert made == {"calculated": 92, "inserted": 92, "updated": 0}
    assert jobs.generate_features(store, as_of, NOW) == {"calculated": 92, "inserted": 0, "updated": 92}
    assert store.table("feature_definitions").count() == 23
    assert jobs.run_predictions(store, as_of, NOW, run_id="r1") == {"calculated": 4, "inserted": 4, "updated": 0}
    counts = {"calculated": 4, "inserted": 4, "updated": 0, "targets": 4, "runs": 1, "skipped": 0}
    assert jobs.run_evaluation(store, NOW) == counts
    # A repeated run takes the predictions over; their evaluations keep the first run.
    # The instant may be spelt in another zone: ids stay, no evaluation loses its prediction.
    kept = {r["entry_id"]: r["prediction_id"] for r in store.table("predictions").collect()}
    again = as_of.astimezone(timezone(timedelta(hours=9)))
    assert jobs.run_predictions(store, again, NOW, run_id="r2") == {"calculated": 4, "inserted": 0, "updated": 4}
    assert kept == {r["entry_id"]: r["prediction_id"] for r in store.table("predictions").collect()}
    assert jobs.run_evaluation(store, NOW) == {**counts, "inserted": 0, "updated": 4}
    assert {r["prediction_id"] for r in store.table("evaluations").collect()} == set(kept.values())
    assert {r["run_id"] for r in store.table("predictions").collect()} == {"r2"}
    assert {r["run_id"] for r in store.table("evaluations").collect()} == {"r1"}
    later = {r["entry_id"]: r for r in store.table("feature_rows").collect()}
    assert sum(r["horse_has_past_race"] for r in later.values()) == 2
    assert {r["status"] for r in store.history("prediction_runs").collect()} == {"succeeded"}


def test_errors_reject_everything(spark, store, tmp_path):
    before = sorted(map(str, store.table("races").collect()))
    races = [FILES["races"][1][0].replace("confirmed", "odd"), FILES["races"][1][1]]
    with pytest.raises(jobs.ImportRejected):
        jobs.import_bundle(store, bundle(tmp_path, "bad", races=races), NOW, batch_id="bad")
    found = store.import_errors().filter("batch_id = 'bad'").withColumn("line", ingest.error_line()).collect()
    assert [(e["row_number"], e["error_code"], e["source_id"]) for e in found] == [(2, "VALIDATION_ERROR", "R1")]
    assert found[0]["line"].startswith("- races.sample.csv / row 2 / source R1: [VALIDATION_ERROR] status: ")
    with pytest.raises(jobs.ImportRejected):
        jobs.import_bundle(store, bundle(tmp_path, "lost", horses=FILES["horses"][1][:1]), NOW, batch_id="lost")
    lost = store.import_errors().filter("batch_id = 'lost'").collect()
    assert sorted((e["entity_type"], e["error_message"]) for e in lost) == [
        ("race_entry", "source_horse_id=H2"), ("race_entry", "source_horse_id=H2"),
        ("race_result", "source_entry_id=E1-2"), ("race_result", "source_entry_id=E20-2"),
    ]
    twice = FILES["race_entries"][1][:-1] + [FILES["race_entries"][1][-1].replace(",1,2,55.0", ",1,1,55.0")]
    with pytest.raises(jobs.ImportRejected):
        jobs.import_bundle(store, bundle(tmp_path, "twice", race_entries=twice), NOW, batch_id="twice")
    with pytest.raises(Exception):
        jobs.import_bundle(store, str(tmp_path / "absent"), NOW, batch_id="absent")
    states = {r["batch_id"]: (r["status"], r["failed_rows"]) for r in store.history("import_batches").collect()}
    assert states["bad"] == ("failed", 1) and states["lost"] == ("failed", 4)
    assert states["twice"] == ("failed", 1) and states["absent"] == ("failed", 1)
    assert sorted(map(str, store.table("races").collect())) == before


def test_commands(spark, store, tmp_path, capsys):
    root = str(tmp_path / "tables")
    assert commands.main(["import", "--store", root, "--source-dir", bundle(tmp_path, "good"), "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["valid"] == 14
    assert commands.main(["clean", "--store", root, "--before", "2026-06-19T00:00:00+00:00"]) == 0
    assert json.loads(capsys.readouterr().out) == {"command": "clean", "deleted": 0}
    assert commands.main(["import", "--store", root, "--source-dir", str(tmp_path / "absent")]) == 1
    assert capsys.readouterr().err
    assert commands.main(["predictions", "--store", root, "--model-version", "none", "--as-of-at", "2026-06-19T00:00:00+00:00"]) == 1
    with pytest.raises(SystemExit):
        commands.main(["features", "--store", root, "--as-of-at", "2026-06-19T00:00:00"])
