"""Posting analytics on Spark: snapshot-diff ETL with text classification and a state table.

Every public function takes DataFrames (or Columns) plus parameters and returns DataFrames
(or Columns). Time is always an argument; nothing reads the clock.
"""
