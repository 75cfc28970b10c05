"""Evaluation analytics for agent traces, written as Spark jobs.

Tables of traces, predictions and runs go in as DataFrames; every statistic comes
back as a DataFrame whose plan is built from joins, grouped aggregates, windows
and Structured Streaming state.
"""
