"""The test-data adapter as SQL text, for the DuckDB oracle (see testviews.py).

``PREFIX`` is a ``WITH`` list defining teams, players, games, team_game_stats,
player_game_stats, shot_attempts and seasons over the driver's pre-registered
TPC-H-like views. Oracle queries append ``, more_ctes AS (...) SELECT ...``.

Rounding helpers produce exact half-away-from-zero results with integer
arithmetic, because DuckDB divides decimals in double precision.
"""

from __future__ import annotations


def rnd(num: str, den: str, digits: int = 3) -> str:
    """ROUND(num / den, digits) exactly, NULL when den is 0 or NULL (den >= 0)."""
    scale = 10**digits
    n = f"CAST(({num}) AS BIGINT)"
    d = f"CAST(({den}) AS BIGINT)"
    return (
        f"(CASE WHEN {d} IS NULL OR {d} = 0 THEN NULL ELSE CAST(sign({n}) * "
        f"((abs({n}) * {2 * scale} + {d}) // (2 * {d})) AS DOUBLE) / {scale}.0 END)"
    )


def ravg(col: str, digits: int = 1, col_scale: int = 0) -> str:
    """ROUND(AVG(col), digits) exactly; ``col_scale`` = decimal places of col."""
    f = 10**col_scale
    return rnd(f"SUM({col}) * {f}", f"COUNT({col}) * {f}", digits)


def _pct(made: str, att: str) -> str:
    return f"CAST({rnd(made, att, 3)} AS DECIMAL(5,3))"


def _season(d: str) -> str:
    y = f"(CASE WHEN month({d}) >= 10 THEN year({d}) ELSE year({d}) - 1 END)"
    return f"(CAST({y} AS VARCHAR) || '-' || lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0'))"


_SUMMED = ("rebounds", "offensive_rebounds", "defensive_rebounds", "assists", "steals", "blocks",
           "turnovers", "personal_fouls", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta")

PREFIX = f"""
WITH
gk AS (
  SELECT o.o_orderkey AS k,
         '002' || lpad(CAST(o.o_orderkey AS VARCHAR), 7, '0') AS id,
         CAST(o.o_orderdate AS DATE) AS game_date,
         {_season('CAST(o.o_orderdate AS DATE)')} AS season,
         CAST(c.c_nationkey + 1 AS BIGINT) AS home_team_id,
         CAST((c.c_nationkey + 1 + o.o_orderkey % 24) % 25 + 1 AS BIGINT) AS away_team_id,
         CAST(80 + (o.o_orderkey * 7) % 61 AS INTEGER) AS home_score,
         CAST(80 + (o.o_orderkey * 13) % 61 AS INTEGER) AS away_score
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
teams AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS full_name,
         'T' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS abbreviation,
         n_name AS nickname, 'City ' || CAST(n_nationkey AS VARCHAR) AS city,
         'State ' || CAST(n_regionkey AS VARCHAR) AS state,
         CAST(1946 + n_nationkey AS INTEGER) AS year_founded
  FROM nation
),
players AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS full_name,
         p_name AS first_name, CAST(p_partkey AS VARCHAR) AS last_name, p_size % 4 <> 0 AS is_active
  FROM part
),
games AS (
  SELECT id, game_date, season, home_team_id, away_team_id, home_score, away_score FROM gk
),
box0 AS (
  SELECT l_orderkey, l_partkey,
         CAST(SUM(l_quantity) AS BIGINT) AS q, CAST(SUM(l_linenumber) AS BIGINT) AS ln,
         MIN(l_suppkey) AS s, (MAX(l_returnflag) = 'R' AND MIN(l_linestatus) = 'O') AS dnp,
         CAST(COUNT(*) AS INTEGER) AS fga,
         CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS fgm,
         CAST(SUM(CASE WHEN l_linenumber >= 4 THEN 1 ELSE 0 END) AS INTEGER) AS fg3a,
         CAST(SUM(CASE WHEN l_linenumber >= 4 AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS fg3m
  FROM lineitem GROUP BY l_orderkey, l_partkey
),
box1 AS (
  SELECT '002' || lpad(CAST(b.l_orderkey AS VARCHAR), 7, '0') AS game_id,
         CAST(b.l_partkey + 1 AS BIGINT) AS player_id,
         CASE WHEN b.s % 2 = 0 THEN gk.home_team_id ELSE gk.away_team_id END AS team_id,
         gk.season,
         CASE WHEN NOT b.dnp THEN CAST(12 + (b.q * 3) % 30 + (b.ln % 2) * 0.5 AS DECIMAL(5,1)) END AS minutes,
         b.q, b.ln, b.fga, b.fgm, b.fg3a, b.fg3m,
         b.q % 7 AS fta, (b.q * 5) % (b.q % 7 + 1) AS ftm, (b.q + b.ln) % 16 AS reb
  FROM box0 b JOIN gk ON b.l_orderkey = gk.k
),
player_game_stats AS (
  SELECT game_id, player_id, team_id, season, minutes,
         CAST(fgm * 2 + fg3m + ftm AS INTEGER) AS points,
         CAST(reb AS INTEGER) AS rebounds,
         CAST(reb % 4 AS INTEGER) AS offensive_rebounds,
         CAST(reb - reb % 4 AS INTEGER) AS defensive_rebounds,
         CAST((q * 7) % 13 AS INTEGER) AS assists,
         CAST(ln % 4 AS INTEGER) AS steals,
         CAST((q + ln * 3) % 4 AS INTEGER) AS blocks,
         CAST((q * 5) % 7 AS INTEGER) AS turnovers,
         CAST((q + ln) % 7 AS INTEGER) AS personal_fouls,
         fgm, fga, {_pct('fgm', 'fga')} AS fg_pct,
         fg3m, fg3a, {_pct('fg3m', 'fg3a')} AS fg3_pct,
         CAST(ftm AS INTEGER) AS ftm, CAST(fta AS INTEGER) AS fta, {_pct('ftm', 'fta')} AS ft_pct,
         CAST(q % 31 - 15 AS DECIMAL(6,1)) AS plus_minus
  FROM box1
),
shots0 AS (
  SELECT l.*,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS INTEGER) AS event_id,
         MIN(l_suppkey) OVER (PARTITION BY l_orderkey, l_partkey) AS s
  FROM lineitem l
),
shot_attempts AS (
  SELECT '002' || lpad(CAST(x.l_orderkey AS VARCHAR), 7, '0') AS game_id,
         x.event_id,
         CAST(x.l_partkey + 1 AS BIGINT) AS player_id,
         CASE WHEN x.s % 2 = 0 THEN gk.home_team_id ELSE gk.away_team_id END AS team_id,
         gk.season,
         CAST(1 + (x.event_id - 1) % 4 AS INTEGER) AS period,
         CAST(x.l_partkey % 12 AS INTEGER) AS minutes_remaining,
         CAST(x.l_suppkey % 60 AS INTEGER) AS seconds_remaining,
         CASE x.l_suppkey % 5 WHEN 0 THEN 'Jump Shot' WHEN 1 THEN 'Driving Layup Shot'
              WHEN 2 THEN 'Pullup Jump Shot' WHEN 3 THEN 'Dunk Shot' WHEN 4 THEN 'Step Back Jump Shot' END AS action_type,
         CASE WHEN x.l_linenumber >= 4 THEN '3PT Field Goal' ELSE '2PT Field Goal' END AS shot_type,
         CASE x.l_linenumber WHEN 1 THEN 'Restricted Area' WHEN 2 THEN 'In The Paint (Non-RA)'
              WHEN 3 THEN 'Mid-Range' WHEN 4 THEN 'Left Corner 3' WHEN 5 THEN 'Right Corner 3'
              WHEN 6 THEN 'Above the Break 3' WHEN 7 THEN 'Backcourt' END AS zone_basic,
         CASE WHEN x.l_linenumber = 4 THEN 'Left Side(L)' WHEN x.l_linenumber = 5 THEN 'Right Side(R)'
              WHEN x.l_linenumber = 7 THEN 'Back Court(BC)'
              ELSE CASE x.l_partkey % 3 WHEN 0 THEN 'Center(C)' WHEN 1 THEN 'Left Side(L)' WHEN 2 THEN 'Right Side(R)' END
         END AS zone_area,
         CASE x.l_linenumber WHEN 1 THEN 'Less Than 8 ft.' WHEN 2 THEN '8-16 ft.' WHEN 3 THEN '16-24 ft.'
              WHEN 4 THEN '24+ ft.' WHEN 5 THEN '24+ ft.' WHEN 6 THEN '24+ ft.' WHEN 7 THEN 'Back Court Shot' END AS zone_range,
         CAST(CASE WHEN x.l_linenumber = 1 THEN x.l_partkey % 4
                   WHEN x.l_linenumber = 2 THEN 8 + x.l_partkey % 8
                   WHEN x.l_linenumber = 3 THEN 16 + x.l_partkey % 8
                   WHEN x.l_linenumber <= 5 THEN 22 + x.l_partkey % 3
                   WHEN x.l_linenumber = 6 THEN 24 + x.l_partkey % 6
                   ELSE 40 + x.l_partkey % 30 END AS INTEGER) AS shot_distance,
         CAST((x.l_partkey * 7) % 501 - 250 AS INTEGER) AS loc_x,
         CAST((x.l_suppkey * 11) % 400 - 50 AS INTEGER) AS loc_y,
         x.l_linestatus = 'F' AS shot_made
  FROM shots0 x JOIN gk ON x.l_orderkey = gk.k
),
tsums AS (
  SELECT game_id, team_id, {', '.join(f'SUM({c}) AS {c}' for c in _SUMMED)}
  FROM player_game_stats GROUP BY game_id, team_id
),
tlegs AS (
  SELECT id AS game_id, season, home_team_id AS team_id, TRUE AS is_home, home_score AS score, away_score AS opp FROM games
  UNION ALL
  SELECT id AS game_id, season, away_team_id AS team_id, FALSE AS is_home, away_score AS score, home_score AS opp FROM games
),
team_game_stats AS (
  SELECT l.game_id, l.team_id, l.season, l.is_home, 240 AS minutes, CAST(l.score AS INTEGER) AS points,
         {', '.join(f'CAST(COALESCE(s.{c}, 0) AS INTEGER) AS {c}' for c in _SUMMED[:8])},
         CAST(COALESCE(s.fgm, 0) AS INTEGER) AS fgm, CAST(COALESCE(s.fga, 0) AS INTEGER) AS fga,
         {_pct('COALESCE(s.fgm, 0)', 'COALESCE(s.fga, 0)')} AS fg_pct,
         CAST(COALESCE(s.fg3m, 0) AS INTEGER) AS fg3m, CAST(COALESCE(s.fg3a, 0) AS INTEGER) AS fg3a,
         {_pct('COALESCE(s.fg3m, 0)', 'COALESCE(s.fg3a, 0)')} AS fg3_pct,
         CAST(COALESCE(s.ftm, 0) AS INTEGER) AS ftm, CAST(COALESCE(s.fta, 0) AS INTEGER) AS fta,
         {_pct('COALESCE(s.ftm, 0)', 'COALESCE(s.fta, 0)')} AS ft_pct,
         CAST(l.score - l.opp AS DECIMAL(6,1)) AS plus_minus
  FROM tlegs l LEFT JOIN tsums s ON s.game_id = l.game_id AND s.team_id = l.team_id
),
seasons AS (
  SELECT g.season AS id,
         CAST(split_part(g.season, '-', 1) AS INTEGER) AS start_year,
         CAST(CAST(split_part(g.season, '-', 1) AS INTEGER)
              + ((CAST(split_part(g.season, '-', 2) AS INTEGER) - CAST(split_part(g.season, '-', 1) AS INTEGER) % 100 + 100) % 100)
              AS INTEGER) AS end_year,
         CAST(g.n AS INTEGER) AS games_count,
         CAST(COALESCE(p.n, 0) AS INTEGER) AS players_count,
         TIMESTAMP '2026-01-01 00:00:00' AS loaded_at,
         CAST(COALESCE(s.n, 0) AS BIGINT) AS shot_attempts_count,
         TIMESTAMP '2026-01-01 00:00:00' AS manifest_generated_at,
         TIMESTAMP '2026-01-01 00:00:00' AS verified_at,
         'passed' AS verification_status,
         sha256(g.season) AS manifest_sha256
  FROM (SELECT season, COUNT(*) AS n FROM games GROUP BY season) g
  LEFT JOIN (SELECT season, COUNT(DISTINCT player_id) AS n FROM player_game_stats GROUP BY season) p ON p.season = g.season
  LEFT JOIN (SELECT season, COUNT(*) AS n FROM shot_attempts GROUP BY season) s ON s.season = g.season
)"""


def with_prefix(body: str) -> str:
    """Oracle SQL = adapter CTEs + ``body`` (which may start with ``, name AS (...)``)."""
    body = body.strip()
    if body.startswith(","):
        return PREFIX + body
    return PREFIX + "\n" + body


# --- seeded faults (see seeded.py) -----------------------------------------------------
def _n(column: str) -> str:
    return f"CAST(substr({column}, 4, 7) AS INTEGER)"


_FAULTY = f"""
, g_r AS (SELECT *, {_n('id')} % 101 AS r FROM games),
g_all AS (SELECT * FROM g_r UNION ALL SELECT * FROM g_r WHERE r = 7),
fx_games AS (
  SELECT CASE r WHEN 9 THEN '003' || substr(id, 4, 7) ELSE id END AS id,
         CASE r WHEN 5 THEN NULL ELSE game_date END AS game_date, season,
         CASE r WHEN 8 THEN 999 ELSE home_team_id END AS home_team_id,
         CASE r WHEN 4 THEN home_team_id ELSE away_team_id END AS away_team_id,
         CASE r WHEN 1 THEN -home_score WHEN 2 THEN NULL ELSE home_score END AS home_score,
         CASE r WHEN 3 THEN -5 ELSE away_score END AS away_score
  FROM g_all
),
t_r AS (SELECT *, {_n('game_id')} % 101 AS r FROM team_game_stats),
t_all AS (
  SELECT * FROM t_r WHERE r <> 14 AND NOT (r = 13 AND NOT is_home)
  UNION ALL SELECT * FROM t_r WHERE r = 15 AND NOT is_home
),
fx_team_game_stats AS (
  SELECT * EXCLUDE (r) REPLACE (
    CASE WHEN r = 11 AND is_home THEN points + 1 WHEN r = 17 AND is_home THEN -3 ELSE points END AS points,
    is_home OR r = 12 AS is_home,
    CASE WHEN r = 16 AND is_home THEN 998 ELSE team_id END AS team_id,
    CASE WHEN r = 17 AND is_home THEN -1 ELSE rebounds END AS rebounds,
    CASE WHEN r = 17 AND is_home THEN -1 ELSE assists END AS assists,
    CASE WHEN r = 18 AND is_home THEN fga + 1 ELSE fgm END AS fgm,
    CASE WHEN r = 18 AND is_home THEN fg3a + 1 ELSE fg3m END AS fg3m,
    CASE WHEN r = 18 AND is_home THEN fta + 1 ELSE ftm END AS ftm,
    CASE WHEN r = 19 AND is_home THEN '1900-01' ELSE season END AS season)
  FROM t_all
),
p_r AS (SELECT *, {_n('game_id')} % 101 AS r FROM player_game_stats),
p_all AS (SELECT * FROM p_r WHERE r <> 30 UNION ALL SELECT * FROM p_r WHERE r = 23),
fx_player_game_stats AS (
  SELECT * EXCLUDE (r) REPLACE (
    CASE r WHEN 21 THEN -1 WHEN 29 THEN 101 ELSE points END AS points,
    CASE r WHEN 21 THEN -1 ELSE rebounds END AS rebounds,
    CASE r WHEN 21 THEN -1 ELSE assists END AS assists,
    CASE r WHEN 22 THEN fga + 1 ELSE fgm END AS fgm,
    CASE r WHEN 22 THEN fg3a + 1 ELSE fg3m END AS fg3m,
    CASE r WHEN 22 THEN fta + 1 ELSE ftm END AS ftm,
    CASE r WHEN 24 THEN '1900-01' ELSE season END AS season,
    CASE r WHEN 25 THEN player_id + 5000000 ELSE player_id END AS player_id,
    CASE r WHEN 26 THEN 997 ELSE team_id END AS team_id,
    CASE r WHEN 27 THEN fga + 1 WHEN 28 THEN fga + 2 ELSE fga END AS fga,
    CASE r WHEN 27 THEN fg3a + 1 ELSE fg3a END AS fg3a,
    CASE r WHEN 29 THEN CAST(1.5 AS DECIMAL(5,3)) ELSE fg_pct END AS fg_pct)
  FROM p_all
),
s_r AS (SELECT *, {_n('game_id')} % 101 AS r FROM shot_attempts),
s_all AS (
  SELECT *, FALSE AS again FROM s_r WHERE r <> 40
  UNION ALL SELECT *, TRUE FROM s_r WHERE r IN (36, 39)
),
fx_shot_attempts AS (
  SELECT * EXCLUDE (r, again) REPLACE (
    CASE r WHEN 31 THEN 21 ELSE period END AS period,
    CASE r WHEN 32 THEN 401 ELSE loc_x END AS loc_x,
    CASE r WHEN 32 THEN -101 ELSE loc_y END AS loc_y,
    CASE r WHEN 33 THEN 13 ELSE minutes_remaining END AS minutes_remaining,
    CASE r WHEN 33 THEN 101 ELSE shot_distance END AS shot_distance,
    CASE r WHEN 34 THEN '4PT Field Goal' ELSE shot_type END AS shot_type,
    CASE r WHEN 35 THEN '  ' ELSE zone_area END AS zone_area,
    CASE WHEN r = 36 AND again THEN '1900-01' ELSE season END AS season,
    CASE r WHEN 37 THEN player_id + 5000000 ELSE player_id END AS player_id,
    CASE WHEN r = 38 THEN 996 WHEN r = 39 AND again THEN 995 ELSE team_id END AS team_id,
    CASE WHEN r = 39 AND again THEN event_id + 100 ELSE event_id END AS event_id)
  FROM s_all
),
fx_seasons AS (
  SELECT * REPLACE (
    CASE start_year WHEN 2000 THEN games_count + 1 WHEN 1996 THEN -1 ELSE games_count END AS games_count,
    CASE start_year WHEN 2000 THEN players_count + 1 ELSE players_count END AS players_count,
    CASE start_year WHEN 1994 THEN 'failed' ELSE verification_status END AS verification_status,
    CASE start_year WHEN 1994 THEN 'xyz' WHEN 1996 THEN NULL ELSE manifest_sha256 END AS manifest_sha256,
    CASE start_year WHEN 1995 THEN shot_attempts_count - 1 ELSE shot_attempts_count END AS shot_attempts_count,
    CASE start_year WHEN 1995 THEN end_year + 1 ELSE end_year END AS end_year)
  FROM seasons WHERE start_year <> 1999
  UNION ALL
  SELECT * REPLACE ('2030-31' AS id, 2030 AS start_year, 2031 AS end_year) FROM seasons WHERE start_year = 1997
),
fx_teams AS (
  SELECT * REPLACE (CASE WHEN id % 12 = 0 THEN 'DUP' ELSE abbreviation END AS abbreviation,
                    CASE WHEN id = 5 THEN 1900 ELSE year_founded END AS year_founded) FROM teams
),
fx_players AS (
  SELECT * FROM players UNION ALL SELECT * REPLACE (id + 10000000 AS id) FROM players WHERE is_active
)"""

#: cells that only the text form can hold: (table, column) -> SQL of the spoiled cell
TEXT_FAULTS = {
    ("teams", "full_name"): "CASE WHEN id % 7 = 3 THEN NULL ELSE full_name END",
    ("players", "is_active"): "CASE WHEN id % 50 = 7 THEN 'yes' ELSE CAST(is_active AS VARCHAR) END",
    ("player_game_stats", "steals"):
        f"CASE {_n('game_id')} % 101 WHEN 51 THEN 'n/a' WHEN 52 THEN 'NaN' WHEN 53 THEN '1.5' "
        "WHEN 54 THEN 'Infinity' WHEN 55 THEN NULL ELSE CAST(steals AS VARCHAR) END",
}

_MOVED = "CASE WHEN {c} <= 25 THEN {c} + 20000000 ELSE {c} END AS {c}"
_ROSTER = f"""
, fx_player_game_stats AS (
  SELECT * REPLACE ({_MOVED.format(c='player_id')}) FROM player_game_stats
  UNION ALL
  SELECT * REPLACE (CASE WHEN {_n('game_id')} % 2 = 1 AND team_id % 5 = 0 THEN team_id - 1 ELSE team_id END AS player_id)
  FROM player_game_stats
  QUALIFY row_number() OVER (PARTITION BY game_id, team_id ORDER BY player_id) = 1
),
fx_players AS (SELECT * FROM players UNION ALL SELECT * REPLACE (id + 20000000 AS id) FROM players WHERE id <= 25)"""


def _shadowed(changes: str, names: tuple[str, ...], body: str) -> str:
    """``body`` over the changed tables: an inner WITH gives them the clean tables' names."""
    body = body.strip()
    inner = ", ".join(f"{n} AS (SELECT * FROM fx_{n})" for n in names)
    return f"{PREFIX}{changes}\nSELECT * FROM (WITH {inner}\n{body}\n) shadowed"


def with_faults(body: str) -> str:
    return _shadowed(_FAULTY, ("teams", "players", "games", "team_game_stats", "player_game_stats",
                               "shot_attempts", "seasons"), body)


def with_faulty_seasons(body: str) -> str:
    return _shadowed(_FAULTY, ("seasons",), body)


def with_roster(body: str) -> str:
    return _shadowed(_ROSTER, ("player_game_stats", "players"), body)
