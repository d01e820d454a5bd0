"""Keelson: catalogue, lead and evidence jobs for a brokerage, written as Spark plans.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing is collected; Catalyst and AQE choose the physical strategy.
"""
