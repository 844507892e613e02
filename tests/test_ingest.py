"""Sources and transforms: result-set documents, partitioned extracts, clean CSV, digests."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from statlake.operators import transforms as tf
from statlake.sources import files, resultset

GAME_ID = "0022400001"
SEASON = "2024-25"
HEADERS = ["GAME_ID", "GAME_EVENT_ID", "PLAYER_ID", "TEAM_ID", "PERIOD", "MINUTES_REMAINING", "SECONDS_REMAINING",
           "ACTION_TYPE", "SHOT_TYPE", "SHOT_ZONE_BASIC", "SHOT_ZONE_AREA", "SHOT_ZONE_RANGE", "SHOT_DISTANCE",
           "LOC_X", "LOC_Y", "SHOT_MADE_FLAG"]


def shot_response(team_id=1610612747, made=1):
    return {"resultSets": [
        {"name": "Shot_Chart_Detail", "headers": HEADERS,
         "rowSet": [[GAME_ID, 7, 2544, team_id, 1, 10, 42, "Driving Layup Shot", "2PT Field Goal", "Restricted Area",
                     "Center(C)", "Less Than 8 ft.", 2, -12, 18, made]]},
        {"name": "LeagueAverages", "headers": [], "rowSet": []},
    ]}


def _write(folder, name, doc):
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        json.dump(doc, fh)
    return path


def test_resultset_to_shot_rows(spark):
    d = tempfile.mkdtemp(prefix="statlake-test-")
    path = _write(d, "shots.json", shot_response())
    rows = resultset.columns(resultset.read_resultset(spark, path), HEADERS)
    out = [r.asDict() for r in tf.transform_shot_attempts(rows, SEASON).collect()]
    assert out == [dict(game_id=GAME_ID, event_id=7, player_id=2544, team_id=1610612747, season=SEASON, period=1,
                        minutes_remaining=10, seconds_remaining=42, action_type="Driving Layup Shot",
                        shot_type="2PT Field Goal", zone_basic="Restricted Area", zone_area="Center(C)",
                        zone_range="Less Than 8 ft.", shot_distance=2, loc_x=-12, loc_y=18, shot_made=True)]


def test_combine_partitioned_extract_contract(spark):
    d = tempfile.mkdtemp(prefix="statlake-test-")
    a = _write(d, "team-1610612747.json", shot_response(1610612747))
    b = _write(d, "team-1610612738.json", shot_response(1610612738))
    docs = resultset.read_documents(spark, d)
    mapping = resultset.requested_team_by_file(docs)
    assert resultset.combine_partitioned_extract(docs, mapping).count() == 2
    wrong = mapping.withColumn("requested_team_id", F.lit(1610612738).cast("bigint"))
    with pytest.raises(resultset.ExtractContractError):
        resultset.combine_partitioned_extract(docs, wrong)
    empty_dir = tempfile.mkdtemp(prefix="statlake-test-")
    _write(empty_dir, "team.json", {"resultSets": [{"name": "x", "headers": HEADERS, "rowSet": []}]})
    with pytest.raises(resultset.ExtractContractError):
        resultset.combine_partitioned_extract(resultset.read_documents(spark, empty_dir), mapping)
    without = tempfile.mkdtemp(prefix="statlake-test-")
    _write(without, "team.json", {"resultSets": []})
    with pytest.raises(resultset.ExtractContractError, match="no result set"):
        resultset.combine_partitioned_extract(resultset.read_documents(spark, without), mapping)


def test_player_name_parsing(spark):
    rows = spark.createDataFrame(
        [("1", "LeBron James", "James, LeBron", "1"), ("2", "Nene", "Nene", "0"), ("3", "X Y", "Y,X", "1"),
         ("4", "A B C", "C, A, B", "0")],
        "PERSON_ID string, DISPLAY_FIRST_LAST string, DISPLAY_LAST_COMMA_FIRST string, ROSTERSTATUS string")
    out = {r.id: (r.first_name, r.last_name, r.is_active) for r in tf.transform_players(rows).collect()}
    assert out == {1: ("LeBron", "James", True), 2: (None, None, False), 3: (None, "Y,X", True), 4: ("A, B", "C", False)}


def test_games_from_team_log(spark):
    log = spark.createDataFrame(
        [("s", 0, GAME_ID, "2024-11-01", "BOS @ LAL", "1610612738", "BOS", "100"),
         ("s", 1, GAME_ID, "2024-11-01", "LAL vs. BOS", "1610612747", "LAL", "110")],
        "source_file string, row_number int, GAME_ID string, GAME_DATE string, MATCHUP string, TEAM_ID string, "
        "TEAM_ABBREVIATION string, PTS string")
    g = tf.transform_games(log, SEASON).collect()
    assert [(r.id, r.home_team_id, r.away_team_id, r.home_score, r.away_score) for r in g] == [
        (GAME_ID, 1610612747, 1610612738, 110, 100)]


def test_load_dataset_reports_all_missing_and_digests(spark):
    root = tempfile.mkdtemp(prefix="statlake-test-")
    os.makedirs(os.path.join(root, "shared"))
    with open(os.path.join(root, "shared", "teams.csv"), "w") as fh:
        fh.write("id,full_name\n1,A\n")
    with pytest.raises(files.MissingFilesError) as err:
        files.load_dataset(spark, root, SEASON)
    assert "players.csv" in str(err.value) and "shot_attempts.csv" in str(err.value)
    dig = files.file_digests(spark, [os.path.join(root, "shared", "teams.csv")]).first()
    import hashlib
    assert dig.sha256 == hashlib.sha256(b"id,full_name\n1,A\n").hexdigest()
    csv = files.read_clean_csv(spark, os.path.join(root, "shared", "teams.csv"))
    assert csv.schema["id"].dataType.simpleString() == "string"


def test_atomic_json_report(spark):
    d = tempfile.mkdtemp(prefix="statlake-test-")
    path = os.path.join(d, "report.json")
    files.write_json_atomic(spark, path, {"b": 1, "a": 2})
    files.write_json_atomic(spark, path, {"b": 3, "a": 4})
    assert json.loads(open(path).read()) == {"a": 4, "b": 3}
    assert open(path).read().index('"a"') < open(path).read().index('"b"')
    assert [n for n in os.listdir(d) if n.endswith(".tmp")] == []


def test_land_if_absent(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "landing")
    resultset.land_if_absent(spark.range(3), d)
    resultset.land_if_absent(spark.range(5), d)  # kept: already landed
    assert spark.read.json(d).count() == 3
    resultset.land_if_absent(spark.range(5), d, force=True)
    assert spark.read.json(d).where(F.col("id") >= 0).count() == 5
