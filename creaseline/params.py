"""Thresholds and model settings, all user-settable."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    h2h_balls: int = 6
    batter_balls: int = 30
    bowler_balls: int = 30
    clone_balls: int = 20
    pressure_balls: int = 6
    form_matches: int = 10
    clone_top_k: int = 3
    archetypes: int = 5
    kmeans_seed: int = 42
    kmeans_restarts: int = 20
    kmeans_iterations: int = 500
    pressure_total: int = 165
    pressure_over: int = 16
