"""Match-telemetry analytics on Spark DataFrames.

Change-log tables (damage, teams, positions, eliminations, build pieces) go in; typed, validated analytical tables
(engagements, fights, pokes, pieces, splits, quality gates, parameter sweeps) come out.
"""
