"""Column names of the delivery fact and of the result tables.

Fixed values: the delivery-file layout and the column order of each result table.
"""

DELIVERY_COLUMNS = [
    "match_id", "season", "start_date", "venue", "innings", "ball",
    "batting_team", "bowling_team", "striker", "non_striker", "bowler",
    "runs_off_bat", "extras", "wides", "noballs", "byes", "legbyes", "penalty",
    "wicket_type", "player_dismissed", "other_wicket_type", "other_player_dismissed",
]

NUMERIC_COLUMNS = ["runs_off_bat", "extras", "wides", "noballs", "byes", "legbyes", "penalty"]

# Text columns whose missing value is the empty string rather than NULL.
BLANK_COLUMNS = ["wicket_type", "player_dismissed", "other_wicket_type", "other_player_dismissed"]

PHASES = ["powerplay", "middle", "death"]

# Dismissals that are not charged to the batter.
NOT_CHARGED = ["run out", "obstructing the field", "handled the ball", "timed out"]

MATCH_INFO_COLUMNS = [
    "match_id", "venue", "city", "season", "date", "event", "match_number",
    "toss_winner", "toss_decision", "winner", "winner_runs", "winner_wickets",
    "player_of_match", "teams",
]

_BATTING = [
    "balls_faced", "runs_scored", "dismissals", "dot_balls", "fours", "sixes",
    "strike_rate", "average", "dot_pct", "boundary_pct",
]

TABLE_COLUMNS = {
    "matchups_1v1": ["batter", "bowler", *_BATTING, "dismissal_rate_wilson_lower"],
    "bowler_phase_stats": [
        "bowler", "phase", "runs_conceded", "balls_bowled", "wickets", "dot_balls",
        "fours_conceded", "sixes_conceded", "economy", "bowling_sr", "average", "dot_pct",
        "boundary_concede_pct", "bowling_archetype",
    ],
    "batter_phase_stats": ["batter", "phase", *_BATTING, "dismissal_rate_wilson_lower"],
    "venue_profiles": [
        "venue", "avg_first_innings_score", "matches_played", "avg_second_innings_score",
        "avg_powerplay_runs", "avg_middle_runs", "avg_death_runs", "surface_behavior_index",
        "chase_wins", "total_tosses",
    ],
    "batter_vs_bowling_style": ["batter", "bowling_style", *_BATTING],
    "recent_form": [
        "player", "role", "recent_avg_runs", "recent_avg_sr", "recent_dismissal_rate",
        "recent_economy", "recent_wickets_per_match", "form_trend", "sample_matches",
    ],
    "player_clones": ["player", "clone", "similarity", "clone_rank", "role"],
    "pressure_performance": [
        "player", "balls_faced", "runs_scored", "dismissals", "fours", "sixes", "dot_balls",
        "role", "strike_rate", "dot_pct", "boundary_pct", "dismissal_rate", "pressure_scenario",
    ],
}
