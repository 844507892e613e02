"""Shared fixtures: a local Spark session and the seeded season used by the golden tests.

The seed mirrors the product's own query fixture: two teams, three players
(one with only a did-not-play row), ten games of 110-100, and 295 shots.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from statlake import schemas  # noqa: E402
from statlake.session import local_session  # noqa: E402
from statlake.sources.tables import Tables  # noqa: E402

SEASON = "2024-25"
LAKERS, CELTICS = 1610612747, 1610612738
LEBRON, TATUM, JORDAN = 2544, 1628369, 893


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="statlake-tests")
    yield s
    s.stop()


def _box(game_id, team_id, season, minutes, points, rebounds, assists, fgm, fga, fg3m, fg3a, ftm, fta, **ids):
    row = dict(game_id=game_id, team_id=team_id, season=season, minutes=minutes, points=points, rebounds=rebounds,
               offensive_rebounds=0, defensive_rebounds=0, assists=assists, steals=0, blocks=0, turnovers=0,
               personal_fouls=0, fgm=fgm, fga=fga, fg_pct=None, fg3m=fg3m, fg3a=fg3a, fg3_pct=None, ftm=ftm,
               fta=fta, ft_pct=None, plus_minus=None)
    row.update(ids)
    return row


def seed_rows() -> dict[str, list[dict]]:
    teams = [
        dict(id=LAKERS, full_name="Los Angeles Lakers", abbreviation="LAL", nickname="Lakers", city="Los Angeles",
             state="California", year_founded=1948),
        dict(id=CELTICS, full_name="Boston Celtics", abbreviation="BOS", nickname="Celtics", city="Boston",
             state="Massachusetts", year_founded=1946),
    ]
    players = [
        dict(id=LEBRON, full_name="LeBron James", first_name="LeBron", last_name="James", is_active=True),
        dict(id=TATUM, full_name="Jayson Tatum", first_name="Jayson", last_name="Tatum", is_active=True),
        dict(id=JORDAN, full_name="Michael Jordan", first_name="Michael", last_name="Jordan", is_active=False),
    ]
    games, tgs, pgs, shots = [], [], [], []
    for i in range(1, 11):
        gid = f"00224000{i:02d}"
        games.append(dict(id=gid, game_date=dt.date(2024, 11, i), season=SEASON, home_team_id=LAKERS,
                          away_team_id=CELTICS, home_score=110, away_score=100))
        for team_id, is_home, pts in ((LAKERS, True, 110), (CELTICS, False, 100)):
            r = _box(gid, team_id, SEASON, None, pts, 45, 25, 40, 90, 12, 35, 18, 22)
            r["is_home"] = is_home
            tgs.append(r)
        pgs.append(_box(gid, LAKERS, SEASON, Decimal("36.5"), 30, 8, 9, 12, 20, 2, 6, 4, 5, player_id=LEBRON))
        for s in range(1, 21):
            three, made = s <= 6, s <= 2 or 7 <= s <= 16
            shots.append(dict(
                game_id=gid, event_id=s, player_id=LEBRON, team_id=LAKERS, season=SEASON, period=1 + (s - 1) // 5,
                minutes_remaining=11 - ((s - 1) % 5), seconds_remaining=(s * 7) % 60,
                action_type="Jump Shot" if three else "Driving Layup Shot",
                shot_type="3PT Field Goal" if three else "2PT Field Goal",
                zone_basic="Above the Break 3" if three else "Restricted Area", zone_area="Center(C)",
                zone_range="24+ ft." if three else "Less Than 8 ft.", shot_distance=25 if three else 2,
                loc_x=(s - 10) * 12, loc_y=230 if three else 15 + s, shot_made=made))
        if i <= 5:
            pgs.append(_box(gid, CELTICS, SEASON, Decimal("34.0"), 25, 7, 4, 9, 19, 3, 8, 4, 4, player_id=TATUM))
            for s in range(1, 20):
                three, made = s <= 8, s <= 3 or 9 <= s <= 14
                shots.append(dict(
                    game_id=gid, event_id=100 + s, player_id=TATUM, team_id=CELTICS, season=SEASON,
                    period=1 + (s - 1) // 5, minutes_remaining=11 - ((s - 1) % 5), seconds_remaining=(s * 9) % 60,
                    action_type="Pullup Jump Shot", shot_type="3PT Field Goal" if three else "2PT Field Goal",
                    zone_basic="Above the Break 3" if three else "Mid-Range",
                    zone_area="Right Side(R)" if three else "Center(C)",
                    zone_range="24+ ft." if three else "8-16 ft.", shot_distance=26 if three else 14,
                    loc_x=100 - s * 6, loc_y=245 if three else 120 + s, shot_made=made))
        if i == 10:
            pgs.append(_box(gid, LAKERS, SEASON, None, 0, 0, 0, 0, 0, 0, 0, 0, 0, player_id=JORDAN))
    seasons = [dict(id=SEASON, start_year=2024, end_year=2025, games_count=10, players_count=3,
                    loaded_at=dt.datetime(2025, 1, 1), shot_attempts_count=295, manifest_generated_at=None,
                    verified_at=None, verification_status="untracked", manifest_sha256=None)]
    return dict(seasons=seasons, teams=teams, players=players, games=games, team_game_stats=tgs,
                player_game_stats=pgs, shot_attempts=shots)


def frames(spark, rows: dict[str, list[dict]]) -> Tables:
    out = {}
    for name, schema in schemas.TABLES.items():
        data = [tuple(r.get(f) for f in schema.fieldNames()) for r in rows[name]]
        out[name] = spark.createDataFrame(data, schema)
    return Tables(**out)


@pytest.fixture(scope="session")
def seed(spark) -> Tables:
    return frames(spark, seed_rows())
