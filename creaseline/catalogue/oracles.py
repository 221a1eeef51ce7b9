"""The same results in plain SQL, for checking. Nothing here is used by the operators."""


def _r(value: str, digits: int) -> str:
    """Round half-even on the scaled value."""
    return f"round_even(({value}) * {10 ** digits}, 0) / {10 ** digits}"


def _exact(value: str, digits: int) -> str:
    """Round the stored value exactly, as printing it to that many decimals does."""
    return f"CAST(format('{{:.{digits}f}}', {value}) AS DOUBLE)"


def _n(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


_BASE = """
WITH d AS (
  SELECT CAST(o_orderkey // 60 AS VARCHAR) AS match_id,
         CAST(year(o_orderdate) AS VARCHAR) AS season,
         'NATION_' || CAST((o_orderkey // 60) % 25 AS VARCHAR) AS venue,
         CAST(CASE WHEN o_orderkey % 60 = 59 THEN 3 ELSE 1 + o_orderkey % 2 END AS INTEGER) AS innings,
         CAST(CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 20 ELSE 4 + l_partkey % 16 END AS INTEGER)
           AS over_no,
         l_linenumber AS ball_no,
         n_name || '/' || c_mktsegment AS striker,
         s_name AS bowler,
         CAST(CASE WHEN CAST(l_quantity AS INTEGER) % 10 < 5 THEN 0
                   WHEN CAST(l_quantity AS INTEGER) % 10 < 8 THEN 1
                   WHEN CAST(l_quantity AS INTEGER) % 10 = 8 THEN 4 ELSE 6 END AS DOUBLE) AS bat,
         CAST(round(l_discount * 100) AS INTEGER) AS dc,
         CAST(round(l_tax * 100) AS INTEGER) AS tx,
         CASE WHEN dayofyear(l_shipdate) % 20 <> 0 THEN ''
              WHEN l_returnflag = 'R' THEN 'caught'
              WHEN l_returnflag = 'A' THEN 'bowled'
              WHEN l_linestatus = 'O' THEN 'run out' ELSE 'lbw' END AS wicket_type
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey
),
x AS (
  SELECT *,
         CAST(dc = 10 AS INTEGER) AS wides,
         CAST(dc = 0 AND tx = 8 AS INTEGER) AS noballs,
         CAST(dc = 9 AND tx = 0 AS INTEGER) AS byes,
         CAST(dc = 8 AND tx = 1 AS INTEGER) AS legbyes
  FROM d
),
f AS (
  SELECT *,
         wides = 0 AS legal,
         wicket_type <> '' AS wicket,
         wicket_type NOT IN ('', 'run out') AS batter_out,
         bat = 4 AND wides = 0 AS four,
         bat = 6 AND wides = 0 AS six,
         wides = 0 AND bat = 0 AND noballs + byes + legbyes = 0 AS dot,
         bat + wides + noballs + byes + legbyes AS conceded,
         CASE WHEN over_no BETWEEN 0 AND 5 THEN 'powerplay'
              WHEN over_no BETWEEN 6 AND 14 THEN 'middle'
              WHEN over_no BETWEEN 15 AND 100 THEN 'death' ELSE 'nan' END AS phase
  FROM x
)"""

_INFO = """
info AS (
  SELECT DISTINCT CAST(o_orderkey // 60 AS VARCHAR) AS match_id,
         'NATION_' || CAST((o_orderkey // 60) % 25 AS VARCHAR) AS venue,
         CASE WHEN (o_orderkey // 60) % 3 = 0 THEN 'bat' ELSE 'field' END AS toss_decision,
         CASE WHEN (o_orderkey // 60) % 7 = 0 THEN ''
              ELSE 'NATION_' || CAST((o_orderkey // 60) % 25 AS VARCHAR) END AS winner
  FROM orders
)"""

_BATTING_SUMS = f"""
  CAST(count(*) AS BIGINT) AS balls_faced, sum(bat) AS runs_scored,
  {_n('batter_out')} AS dismissals, {_n('dot')} AS dot_balls,
  {_n('four')} AS fours, {_n('six')} AS sixes"""

_BATTING_RATES = f"""
  balls_faced, runs_scored, dismissals, dot_balls, fours, sixes,
  {_r('runs_scored * 100 / balls_faced', 2)} AS strike_rate,
  CASE WHEN dismissals = 0 THEN runs_scored
       ELSE {_r('runs_scored / nullif(dismissals, 0)', 2)} END AS average,
  {_r('CAST(dot_balls AS DOUBLE) / balls_faced * 100', 2)} AS dot_pct,
  {_r('CAST(fours + sixes AS DOUBLE) / balls_faced * 100', 2)} AS boundary_pct"""

_Z = "CAST(1.96 AS DOUBLE)"
_Z2 = f"({_Z} * {_Z})"
_P = "(CAST(dismissals AS DOUBLE) / balls_faced)"
_N = "CAST(balls_faced AS DOUBLE)"
_WILSON_RAW = (
    f"({_P} + {_Z2} / (2 * {_N})"
    f" - {_Z} * sqrt({_P} * (1 - {_P}) / {_N} + {_Z2} / (4 * {_N} * {_N})))"
    f" / (1 + {_Z2} / {_N})"
)
_WILSON = _r(f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {_WILSON_RAW}))", 4)

_PAIRS = f"""
pairs AS (
  SELECT striker AS batter, bowler, {_BATTING_SUMS} FROM f WHERE legal GROUP BY striker, bowler
)"""
_MATCHUPS = f"""
mu AS (
  SELECT batter, bowler, {_BATTING_RATES}, {_WILSON} AS dismissal_rate_wilson_lower
  FROM pairs WHERE balls_faced >= 6
)"""

_BOWLER_PHASE = f"""
bp AS (
  SELECT bowler, phase, sum(conceded) AS runs_conceded, {_n('legal')} AS balls_bowled,
         {_n('legal AND wicket')} AS wickets, {_n('dot')} AS dot_balls,
         {_n('four')} AS fours_conceded, {_n('six')} AS sixes_conceded
  FROM f GROUP BY bowler, phase HAVING count(*) FILTER (WHERE legal) >= 30
),
bps AS (
  SELECT *, {_r('runs_conceded * 6 / balls_bowled', 2)} AS economy,
         CASE WHEN wickets = 0 THEN 999.0 ELSE
           {_r('CAST(balls_bowled AS DOUBLE) / nullif(wickets, 0)', 2)} END AS bowling_sr,
         CASE WHEN wickets = 0 THEN 999.0 ELSE
           {_r('runs_conceded / nullif(wickets, 0)', 2)} END AS average,
         {_r('CAST(dot_balls AS DOUBLE) / balls_bowled * 100', 2)} AS dot_pct,
         {_r('CAST(fours_conceded + sixes_conceded AS DOUBLE) / balls_bowled * 100', 2)}
           AS boundary_concede_pct
  FROM bp
)"""

_STYLES = f"""
prints AS (
  SELECT bowler, CAST(count(*) AS BIGINT) AS total_balls, {_n('over_no <= 5')} AS pp_balls,
         {_n('over_no BETWEEN 6 AND 14')} AS mid_balls,
         {_n('dot AND over_no BETWEEN 6 AND 14')} AS mid_dots,
         sum(conceded) AS total_runs,
         coalesce(sum(conceded) FILTER (WHERE over_no BETWEEN 6 AND 14), 0.0) AS mid_runs
  FROM f WHERE legal GROUP BY bowler
),
styles AS (
  SELECT *, CASE WHEN total_balls < 30 THEN 'unknown'
                 WHEN mid_balls > 0 AND CAST(mid_dots AS DOUBLE) / mid_balls > 0.28
                  AND CAST(pp_balls AS DOUBLE) / total_balls < 0.22
                  AND mid_runs * 6 / mid_balls < 7.8 THEN 'spin'
                 ELSE 'pace' END AS bowling_style
  FROM prints
)"""

_INNINGS = """
inn AS (
  SELECT match_id, venue, innings, sum(conceded) AS total_runs
  FROM f GROUP BY match_id, venue, innings
)"""

_VENUE_PHASES = f"""
ph AS (
  SELECT match_id, venue, phase, sum(conceded) AS runs
  FROM f WHERE innings = 1 GROUP BY match_id, venue, phase
),
vph AS (
  SELECT venue,
         {_r("coalesce(avg(runs) FILTER (WHERE phase = 'powerplay'), 0)", 1)} AS avg_powerplay_runs,
         {_r("coalesce(avg(runs) FILTER (WHERE phase = 'middle'), 0)", 1)} AS avg_middle_runs,
         {_r("coalesce(avg(runs) FILTER (WHERE phase = 'death'), 0)", 1)} AS avg_death_runs
  FROM ph GROUP BY venue
)"""

_EARLY = """
er AS (
  SELECT match_id, venue, sum(conceded) AS runs, count(*) FILTER (WHERE legal) AS balls
  FROM f WHERE innings = 1 AND over_no <= 2 GROUP BY match_id, venue
),
early AS (
  SELECT match_id, venue,
         runs * 6 / CASE WHEN balls = 0 THEN 18 ELSE balls END AS early_econ
  FROM er
)"""

_SURFACE = f"""
sbi AS (
  SELECT venue,
         {_r('median(early_econ) / (SELECT median(early_econ) FROM early)', 3)}
           AS surface_behavior_index
  FROM early GROUP BY venue
)"""

_TOSS = """
toss AS (
  SELECT venue, CAST(count(*) AS BIGINT) AS chase_wins, CAST(count(*) AS BIGINT) AS total_tosses
  FROM info WHERE toss_decision = 'field' GROUP BY venue
)"""

_PRESSURE = """
pm AS (
  SELECT match_id, sum(conceded) AS fi_score FROM f WHERE innings = 1
  GROUP BY match_id HAVING sum(conceded) >= 165
)"""


def _pressure_side(role: str, player: str, runs: str, out: str) -> str:
    return f"""
  SELECT {player} AS player, '{role}' AS role, CAST(count(*) AS BIGINT) AS balls_faced,
         sum({runs}) AS runs_scored, {_n(out)} AS dismissals, {_n('four')} AS fours,
         {_n('six')} AS sixes, {_n('dot')} AS dot_balls
  FROM late GROUP BY {player}"""


_BATTER_MATCHES = f"""
bm AS (
  SELECT striker AS player, match_id, sum(bat) AS innings_runs,
         CAST(count(*) AS BIGINT) AS balls_faced, {_n('batter_out')} AS outs,
         sum(bat) * 100 / count(*) AS innings_sr
  FROM f WHERE legal GROUP BY striker, match_id
)"""
_BOWLER_MATCHES = f"""
wm AS (
  SELECT bowler AS player, match_id, sum(conceded) AS runs_conceded,
         {_n('legal')} AS balls_bowled, {_n('wicket')} AS wickets,
         CASE WHEN count(*) FILTER (WHERE legal) = 0 THEN 0.0
              ELSE sum(conceded) * 6 / nullif(count(*) FILTER (WHERE legal), 0) END AS economy
  FROM f GROUP BY bowler, match_id
)"""


def _trend(measure: str, better: str, worse: str) -> str:
    late = f"avg({measure}) FILTER (WHERE up > len // 2)"
    soon = f"avg({measure}) FILTER (WHERE up <= len // 2)"
    return (
        f"CASE WHEN count(*) < 4 THEN 'stable' WHEN {better.format(late=late, soon=soon)}"
        f" THEN 'improving' WHEN {worse.format(late=late, soon=soon)} THEN 'declining'"
        f" ELSE 'stable' END"
    )


def _last_ten(source: str, name: str) -> str:
    return f"""
{name}0 AS (
  SELECT *, row_number() OVER (PARTITION BY player ORDER BY match_id DESC) AS back FROM {source}
),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY player ORDER BY match_id) AS up,
         count(*) OVER (PARTITION BY player) AS len
  FROM {name}0 WHERE back <= 10
)"""


_BATTER_TREND = _trend(
    "innings_runs", "{late} > {soon} * CAST(1.15 AS DOUBLE)",
    "{late} < {soon} * CAST(0.85 AS DOUBLE)",
)
_BOWLER_TREND = _trend(
    "economy", "{late} < {soon} * CAST(0.9 AS DOUBLE)", "{late} > {soon} * CAST(1.1 AS DOUBLE)"
)


def _phase_value(phase: str, value: str) -> str:
    return f"coalesce(max({value}) FILTER (WHERE phase = '{phase}'), 0.0)"


_BATTER_FEATURES = f"""
bph AS (
  SELECT striker, phase, sum(bat) * 100 / count(*) AS v FROM f WHERE legal GROUP BY striker, phase
),
bphw AS (
  SELECT striker, {_phase_value('powerplay', 'v')} AS pp_sr, {_phase_value('middle', 'v')} AS mid_sr,
         {_phase_value('death', 'v')} AS death_sr
  FROM bph GROUP BY striker
),
bf AS (
  SELECT striker AS player, sum(bat) * 100 / count(*) AS sr,
         CASE WHEN count(*) FILTER (WHERE batter_out) = 0 THEN sum(bat)
              ELSE sum(bat) / nullif(count(*) FILTER (WHERE batter_out), 0) END AS average,
         CAST(count(*) FILTER (WHERE dot) AS DOUBLE) / count(*) * 100 AS dot_pct,
         CAST(count(*) FILTER (WHERE four OR six) AS DOUBLE) / count(*) * 100 AS boundary_pct,
         any_value(pp_sr) AS pp_sr, any_value(mid_sr) AS mid_sr, any_value(death_sr) AS death_sr
  FROM f JOIN bphw USING (striker) WHERE legal GROUP BY striker HAVING count(*) >= 20
)"""

_BOWLER_FEATURES = f"""
wph AS (
  SELECT bowler, phase,
         CASE WHEN count(*) FILTER (WHERE legal) = 0 THEN 0.0
              ELSE sum(conceded) * 6 / nullif(count(*) FILTER (WHERE legal), 0) END AS v
  FROM f GROUP BY bowler, phase
),
wphw AS (
  SELECT bowler, {_phase_value('powerplay', 'v')} AS pp_econ,
         {_phase_value('middle', 'v')} AS mid_econ, {_phase_value('death', 'v')} AS death_econ
  FROM wph GROUP BY bowler
),
wf AS (
  SELECT bowler AS player, sum(conceded) * 6 / count(*) FILTER (WHERE legal) AS economy,
         CAST(count(*) FILTER (WHERE dot) AS DOUBLE) / count(*) FILTER (WHERE legal) * 100 AS dot_pct,
         CAST(count(*) FILTER (WHERE wicket) AS DOUBLE) / count(*) FILTER (WHERE legal) * 100
           AS wicket_rate,
         any_value(pp_econ) AS pp_econ, any_value(mid_econ) AS mid_econ,
         any_value(death_econ) AS death_econ
  FROM f JOIN wphw USING (bowler) GROUP BY bowler HAVING count(*) FILTER (WHERE legal) >= 20
)"""

_BF = ["sr", "average", "dot_pct", "boundary_pct", "pp_sr", "mid_sr", "death_sr"]
_WF = ["economy", "dot_pct", "wicket_rate", "pp_econ", "mid_econ", "death_econ"]


def _pair_similarity(source: str, names: list[str], role: str) -> str:
    z = ", ".join(
        f"CASE WHEN (SELECT stddev_pop({c}) FROM {source}) = 0 THEN 0.0 ELSE"
        f" ({c} - (SELECT avg({c}) FROM {source})) / (SELECT stddev_pop({c}) FROM {source}) END"
        f" AS {c}"
        for c in names
    )
    dot = " + ".join(f"a.{c} * b.{c}" for c in names)
    norm_a = " + ".join(f"a.{c} * a.{c}" for c in names)
    norm_b = " + ".join(f"b.{c} * b.{c}" for c in names)
    return f"""
{source}z AS (SELECT player, {z} FROM {source}),
{source}s AS (
  SELECT a.player AS player, b.player AS clone,
         ({dot}) / nullif(sqrt({norm_a}) * sqrt({norm_b}), 0) AS sim
  FROM {source}z a JOIN {source}z b ON a.player <> b.player
),
{source}k AS (
  SELECT player, clone, sim, row_number() OVER (
           PARTITION BY player ORDER BY round(sim, 12) DESC, clone) AS rk
  FROM {source}s WHERE sim > 0
),
{source}c AS (
  SELECT player, clone, {_exact('sim', 4)} AS similarity, CAST(rk AS INTEGER) AS clone_rank,
         '{role}' AS role
  FROM {source}k WHERE rk <= 3
)"""


_BATTER_CLONES = _BATTER_FEATURES + "," + _pair_similarity("bf", _BF, "batter")
_BOWLER_CLONES = _BOWLER_FEATURES + "," + _pair_similarity("wf", _WF, "bowler")


def _rounded(names: list[str]) -> str:
    return ", ".join(f"{_r(name, 6)} AS {name}" for name in names)


def _sql(*parts: str) -> str:
    return ",".join([_BASE, *parts[:-1]]) + "\n" + parts[-1]


_PRESSURE_ROWS = f"""
late AS (
  SELECT * FROM f WHERE innings = 2 AND over_no >= 16 AND legal
     AND match_id IN (SELECT match_id FROM pm)
),
sides AS ({_pressure_side('batter', 'striker', 'bat', 'batter_out')}
  UNION ALL {_pressure_side('bowler', 'bowler', 'conceded', 'wicket')}
),
pp AS (
  SELECT *, {_r('runs_scored * 100 / balls_faced', 2)} AS strike_rate,
         {_r('CAST(dot_balls AS DOUBLE) / balls_faced * 100', 2)} AS dot_pct,
         {_r('CAST(fours + sixes AS DOUBLE) / balls_faced * 100', 2)} AS boundary_pct,
         {_r('CAST(dismissals AS DOUBLE) / balls_faced', 4)} AS dismissal_rate,
         'inn2_over16+_target>=165' AS pressure_scenario
  FROM sides WHERE balls_faced >= 6
)"""

_STYLE_ROWS = f"""
bs AS (
  SELECT f.striker AS batter, s.bowling_style AS bowling_style, {_BATTING_SUMS}
  FROM f JOIN styles s ON f.bowler = s.bowler WHERE legal GROUP BY 1, 2
),
bvs AS (
  SELECT batter, bowling_style, {_BATTING_RATES} FROM bs WHERE balls_faced >= 30
)"""

_BATTER_PHASE = f"""
tp AS (
  SELECT striker AS batter, phase, {_BATTING_SUMS} FROM f WHERE legal GROUP BY striker, phase
),
tps AS (
  SELECT batter, phase, {_BATTING_RATES}, {_WILSON} AS dismissal_rate_wilson_lower
  FROM tp WHERE balls_faced >= 30
)"""

_PROFILES = f"""
v1 AS (
  SELECT venue, {_r('avg(total_runs)', 1)} AS avg_first_innings_score,
         CAST(count(*) AS BIGINT) AS matches_played
  FROM inn WHERE innings = 1 GROUP BY venue
),
v2 AS (
  SELECT venue, {_r('avg(total_runs)', 1)} AS avg_second_innings_score
  FROM inn WHERE innings = 2 GROUP BY venue
),
vp AS (
  SELECT v1.venue, avg_first_innings_score, matches_played, avg_second_innings_score,
         avg_powerplay_runs, avg_middle_runs, avg_death_runs,
         coalesce(surface_behavior_index, 1.0) AS surface_behavior_index,
         coalesce(chase_wins, 0) AS chase_wins, coalesce(total_tosses, 0) AS total_tosses
  FROM v1 LEFT JOIN v2 USING (venue) LEFT JOIN vph USING (venue) LEFT JOIN sbi USING (venue)
          LEFT JOIN toss USING (venue)
)"""

_FORM = f"""{_last_ten('bm', 'bl')},{_last_ten('wm', 'wl')},
rf AS (
  SELECT player, 'batter' AS role, {_exact('avg(innings_runs)', 2)} AS recent_avg_runs,
         {_exact('avg(innings_sr)', 2)} AS recent_avg_sr,
         {_exact('avg(outs)', 3)} AS recent_dismissal_rate,
         CAST(NULL AS DOUBLE) AS recent_economy, CAST(NULL AS DOUBLE) AS recent_wickets_per_match,
         {_BATTER_TREND} AS form_trend, CAST(count(*) AS BIGINT) AS sample_matches
  FROM bl GROUP BY player
  UNION ALL
  SELECT player, 'bowler', NULL, NULL, NULL, {_exact('avg(economy)', 2)},
         {_exact('avg(wickets)', 3)}, {_BOWLER_TREND}, CAST(count(*) AS BIGINT)
  FROM wl GROUP BY player
)"""

_MEASURES = (
    "balls_faced, runs_scored, dismissals, dot_balls, fours, sixes, strike_rate, average, dot_pct,"
    " boundary_pct, dismissal_rate_wilson_lower"
)

def _doubles(names: str) -> str:
    return ", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in names.split())


_FALLBACK = f"""
alt AS (
  SELECT p.batter, p.bowler, c.clone AS source_batter, c.similarity, c.clone_rank,
         m.{_MEASURES.replace(', ', ', m.')},
         row_number() OVER (PARTITION BY p.batter, p.bowler ORDER BY c.clone_rank) AS rn
  FROM pairs p
  JOIN bfc c ON c.player = p.batter
  JOIN mu m ON m.batter = c.clone AND m.bowler = p.bowler
  WHERE p.balls_faced < 6
)"""

_TABLE_COUNTS = [
    ("matchups_1v1", "mu"), ("bowler_phase_stats", "bps"), ("batter_phase_stats", "tps"),
    ("venue_profiles", "vp"), ("batter_vs_bowling_style", "bvs"), ("recent_form", "rf"),
    ("player_clones", "(SELECT player FROM bfc UNION ALL SELECT player FROM wfc)"),
    ("pressure_performance", "pp"),
]

_VENUE_PARTS = [_INFO, _INNINGS, _VENUE_PHASES, _EARLY, _SURFACE, _TOSS, _PROFILES]

ORACLES = {
    "matchups_1v1": _sql(_PAIRS, _MATCHUPS, "SELECT * FROM mu"),
    "matchups_presented": _sql(
        _PAIRS, _MATCHUPS, """SELECT *, CAST(row_number() OVER (PARTITION BY batter ORDER BY balls_faced DESC, bowler)
                             AS INTEGER) AS presented FROM mu"""
    ),
    "bowler_phase_stats": _sql(_BOWLER_PHASE, "SELECT * FROM bps"),
    "bowling_archetype_join": _sql(_BOWLER_PHASE, "SELECT * FROM bps"),
    # A clustering that has settled has no bowler nearer to another mean and no claim that fails.
    "archetype_check": _sql(_BOWLER_PHASE, "SELECT DISTINCT bowler, true AS nearest_is_own, true AS claim_holds FROM bps"),
    "batter_phase_stats": _sql(_BATTER_PHASE, "SELECT * FROM tps"),
    "bowler_style": _sql(_STYLES, "SELECT * FROM styles"),
    "deliveries_by_style": _sql(
        _STYLES,
        """SELECT coalesce(bowling_style, 'unknown') AS bowling_style,
                  CAST(count(*) AS BIGINT) AS deliveries, sum(conceded) AS runs_conceded
           FROM f LEFT JOIN styles USING (bowler) GROUP BY 1""",
    ),
    "batter_vs_bowling_style": _sql(_STYLES, _STYLE_ROWS, "SELECT * FROM bvs"),
    "innings_totals": _sql(_INNINGS, "SELECT * FROM inn"),
    "venue_phase_runs": _sql(
        _INNINGS, _VENUE_PHASES,
        """SELECT venue, CAST(count(*) AS BIGINT) AS matches_played,
                  any_value(avg_powerplay_runs) AS avg_powerplay_runs,
                  any_value(avg_middle_runs) AS avg_middle_runs,
                  any_value(avg_death_runs) AS avg_death_runs
           FROM inn JOIN vph USING (venue) WHERE innings = 1 GROUP BY venue""",
    ),
    "early_economy": _sql(
        _EARLY, f"SELECT match_id, venue, {_r('early_econ', 6)} AS early_econ FROM early"
    ),
    "surface_behavior_index": _sql(_EARLY, _SURFACE, "SELECT * FROM sbi"),
    "toss_counts": "WITH" + _INFO + "," + _TOSS + " SELECT * FROM toss",
    "venue_profiles": _sql(*_VENUE_PARTS, "SELECT * FROM vp"),
    "pressure_matches": _sql(_PRESSURE, "SELECT * FROM pm"),
    "pressure_performance": _sql(_PRESSURE, _PRESSURE_ROWS, "SELECT * FROM pp"),
    "batter_matches": _sql(
        _BATTER_MATCHES,
        f"""SELECT player, match_id, innings_runs, balls_faced, outs,
                   {_r('innings_sr', 6)} AS innings_sr FROM bm""",
    ),
    "bowler_matches": _sql(
        _BOWLER_MATCHES,
        f"""SELECT player, match_id, runs_conceded, balls_bowled, wickets,
                   {_r('economy', 6)} AS economy FROM wm""",
    ),
    "recent_form": _sql(_BATTER_MATCHES, _BOWLER_MATCHES, _FORM, "SELECT * FROM rf"),
    "clone_features_batter": _sql(
        _BATTER_FEATURES, f"SELECT player, {_rounded(_BF)} FROM bf"
    ),
    "clone_features_bowler": _sql(
        _BOWLER_FEATURES, f"SELECT player, {_rounded(_WF)} FROM wf"
    ),
    "player_clones": _sql(
        _BATTER_CLONES, _BOWLER_CLONES, "SELECT * FROM bfc UNION ALL SELECT * FROM wfc"
    ),
    "archetype_features": _sql(
        _BOWLER_PHASE,
        f"""SELECT bowler, {_r('avg(economy)', 6)} AS c_economy,
               {_r('avg(dot_pct)', 6)} AS c_dot_pct,
               {_r('coalesce(avg(bowling_sr) FILTER (WHERE bowling_sr < 999), 999)', 6)} AS c_bowl_sr,
               {_r("coalesce(avg(economy) FILTER (WHERE phase = 'death'), 0)", 6)} AS c_death_econ,
               {_r("coalesce(avg(economy) FILTER (WHERE phase = 'powerplay'), 0)", 6)} AS c_pp_econ
            FROM bps GROUP BY bowler""",
    ),
    "table_lookup": _sql(
        _BOWLER_PHASE,
        f"""SELECT s.s_name AS bowler, 'death' AS phase, b.* EXCLUDE (bowler, phase) REPLACE (
                   {_doubles('balls_bowled wickets dot_balls fours_conceded sixes_conceded')})
           FROM supplier s LEFT JOIN bps b ON b.bowler = s.s_name AND b.phase = 'death'""",
    ),
    "matchup_with_fallback": _sql(
        _PAIRS, _MATCHUPS, _BATTER_CLONES, _FALLBACK,
        f"""SELECT * REPLACE ({_doubles('clone_rank balls_faced dismissals dot_balls fours sixes')})
            FROM (
            SELECT batter, bowler, batter AS source_batter, CAST(1 AS DOUBLE) AS similarity,
                   0 AS clone_rank, {_MEASURES} FROM mu
            UNION ALL
            SELECT p.batter, p.bowler, source_batter, similarity, clone_rank,
                   a.{_MEASURES.replace(', ', ', a.')}
            FROM pairs p LEFT JOIN alt a
              ON a.batter = p.batter AND a.bowler = p.bowler AND rn = 1
            WHERE p.balls_faced < 6)""",
    ),
    "delivery_features": _sql(
        """SELECT match_id, innings,
                  CAST(over_no AS VARCHAR) || '.' || CAST(ball_no AS VARCHAR) AS ball,
                  striker, bowler, wides > 0 AS is_wide, noballs > 0 AS is_noball,
                  legal AS is_legal, wicket AS is_wicket, batter_out AS is_batter_out,
                  four AS is_boundary4, six AS is_boundary6, dot AS is_dot,
                  conceded AS runs_conceded, over_no AS over_int, phase
           FROM f""",
    ),
    "load_summary": _sql(
        """SELECT CAST(count(*) AS BIGINT) AS deliveries,
                  CAST(count(DISTINCT match_id) AS BIGINT) AS matches,
                  string_agg(DISTINCT season, ',' ORDER BY season) AS seasons FROM f""",
    ),
    "feature_summary": _sql(
        f"""SELECT {_n('legal')} AS legal_deliveries, {_n('wicket')} AS wickets,
                   {_n("phase = 'powerplay'")} AS powerplay_deliveries,
                   {_n("phase = 'middle'")} AS middle_deliveries,
                   {_n("phase = 'death'")} AS death_deliveries,
                   {_n("phase = 'nan'")} AS no_phase_deliveries FROM f""",
    ),
    "ingest_deliveries": _sql(
        """SELECT match_id, CAST(NULL AS VARCHAR) AS start_date, season, venue, innings,
                  CAST(over_no AS VARCHAR) || '.' || CAST(ball_no AS VARCHAR) AS ball,
                  CAST(NULL AS VARCHAR) AS batting_team, CAST(NULL AS VARCHAR) AS bowling_team,
                  striker, CAST(NULL AS VARCHAR) AS non_striker, bowler, bat AS runs_off_bat,
                  CAST(wides + noballs + byes + legbyes AS DOUBLE) AS extras,
                  CAST(wides AS DOUBLE) AS wides, CAST(noballs AS DOUBLE) AS noballs,
                  CAST(byes AS DOUBLE) AS byes, CAST(legbyes AS DOUBLE) AS legbyes,
                  CAST(0 AS DOUBLE) AS penalty, wicket_type, '' AS player_dismissed,
                  '' AS other_wicket_type, '' AS other_player_dismissed
           FROM f""",
    ),
    "ingest_match_info": "WITH" + _INFO + """
SELECT match_id, venue || ', Ground' AS venue, venue AS city, '2020' AS season,
       '2020/01/0' || (CAST(match_id AS BIGINT) % 9 + 1) AS date, 'Cup of St John"s ' || match_id AS event,
       '' AS match_number, '' AS toss_winner, toss_decision, winner,
       CASE WHEN CAST(match_id AS BIGINT) % 5 = 0 THEN NULL
            ELSE CAST(CAST(match_id AS BIGINT) % 90 AS DOUBLE) END AS winner_runs,
       CAST(NULL AS DOUBLE) AS winner_wickets, 'Surname,' || match_id AS player_of_match,
       'Home ' || match_id || '|Away ' || match_id AS teams
FROM info""",
    "table_report": _sql(
        _PAIRS, _MATCHUPS, _BOWLER_PHASE, _BATTER_PHASE, *_VENUE_PARTS, _STYLES, _STYLE_ROWS,
        _BATTER_MATCHES, _BOWLER_MATCHES, _FORM, _BATTER_CLONES, _BOWLER_CLONES, _PRESSURE,
        _PRESSURE_ROWS,
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, CAST(count(*) AS BIGINT) AS row_count,"
            f" 'OK' AS status FROM {source} t HAVING count(*) > 0"
            for name, source in _TABLE_COUNTS
        ),
    ),
}
