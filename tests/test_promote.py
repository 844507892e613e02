"""End-to-end promotion of a clean season dataset (the lifecycle fixture: 2 teams, 2 players,
one game 110-100, 160 shots) and fail-closed behaviour on a tampered or invalid input."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest

from statlake.operators import crosscheck as cc
from statlake.plans import promote, publish
from statlake.sources import files
from tests.conftest import frames

SEASON = "2025-26"
GAME = "0022500001"
HOME, AWAY = 1610612747, 1610612738
P1, P2 = 1001, 1002


def lifecycle_rows():
    teams = [dict(id=HOME, full_name="Home Team", abbreviation="HOM", nickname="Home", city="A", state="B", year_founded=1950),
             dict(id=AWAY, full_name="Away Team", abbreviation="AWY", nickname="Away", city="C", state="D", year_founded=1950)]
    players = [dict(id=P1, full_name="Player One", first_name="Player", last_name="One", is_active=True),
               dict(id=P2, full_name="Player Two", first_name="Player", last_name="Two", is_active=True)]
    games = [dict(id=GAME, game_date=dt.date(2025, 11, 1), season=SEASON, home_team_id=HOME, away_team_id=AWAY,
                  home_score=110, away_score=100)]

    def box(**kw):
        row = dict(minutes=None, points=0, rebounds=0, offensive_rebounds=0, defensive_rebounds=0, assists=0, steals=0,
                   blocks=0, turnovers=0, personal_fouls=0, fgm=40, fga=80, fg_pct=Decimal("0.500"), fg3m=10, fg3a=30,
                   fg3_pct=Decimal("0.333"), ftm=20, fta=25, ft_pct=Decimal("0.800"), plus_minus=None, season=SEASON,
                   game_id=GAME)
        row.update(kw)
        return row

    tgs = [box(team_id=HOME, is_home=True, minutes=240, points=110), box(team_id=AWAY, is_home=False, minutes=240, points=100)]
    pgs = [box(player_id=P1, team_id=HOME, minutes=Decimal("36.0"), points=40),
           box(player_id=P2, team_id=AWAY, minutes=Decimal("35.5"), points=38)]
    shots = []
    for pid, tid, base in ((P1, HOME, 0), (P2, AWAY, 100)):
        for s in range(1, 81):
            three, made = s <= 30, s <= 10 or 31 <= s <= 60
            shots.append(dict(game_id=GAME, event_id=base + s, player_id=pid, team_id=tid, season=SEASON, period=1 + (s - 1) // 20,
                              minutes_remaining=11, seconds_remaining=s % 60, action_type="Jump Shot",
                              shot_type="3PT Field Goal" if three else "2PT Field Goal",
                              zone_basic="Above the Break 3" if three else "Mid-Range", zone_area="Center(C)",
                              zone_range="24+ ft." if three else "16-24 ft.", shot_distance=25 if three else 18,
                              loc_x=s, loc_y=200 if three else 100, shot_made=made))
    seasons = []
    return dict(seasons=seasons, teams=teams, players=players, games=games, team_game_stats=tgs,
                player_game_stats=pgs, shot_attempts=shots)


def write_clean(spark, rows, root):
    t = frames(spark, rows)
    for name, rel in files.CLEAN_FILES.items():
        files.write_csv(getattr(t, name).coalesce(1), os.path.join(root, rel.format(season=SEASON)))
    return t


def test_promote_end_to_end_and_fail_closed(spark):
    root = tempfile.mkdtemp(prefix="statlake-test-")
    t = write_clean(spark, lifecycle_rows(), root)
    ok = {"status": "passed", "mismatch_count": 0}
    manifest = publish.build_manifest(spark, root, SEASON, ok)
    hashes = {e["name"]: e["sha256"] for e in manifest["files"]}
    teams_feed = cc.as_feed(cc.local_team_totals(t), "team_id", "TEAM_ID", cc.TEAM_STATS)
    players_feed = cc.as_feed(cc.local_player_totals(t), "player_id", "PLAYER_ID", cc.PLAYER_STATS)
    report = cc.build_report(SEASON, cc.crosscheck(t, teams_feed, players_feed), hashes, "feed")
    store_root = os.path.join(tempfile.mkdtemp(prefix="statlake-test-"), "store")
    version = promote.promote_season(spark, root, store_root, SEASON, manifest, report, teams_feed, players_feed,
                                     "feed", single_season=True, expected_teams=2)
    store = publish.DatasetStore(spark, store_root)
    assert store.current_version() == version
    assert store.read().shot_attempts.count() == 160

    bad_report = dict(report, dataset_sha256={**hashes, "games": "0" * 64})
    with pytest.raises(cc.OfficialVerificationError):
        promote.promote_season(spark, root, store_root, SEASON, manifest, bad_report, teams_feed, players_feed, "feed",
                               expected_teams=2)
    with pytest.raises(Exception):  # 30 teams expected by default: the quality gate refuses to publish
        promote.promote_season(spark, root, store_root, SEASON, manifest, report, teams_feed, players_feed, "feed")
    assert store.current_version() == version
