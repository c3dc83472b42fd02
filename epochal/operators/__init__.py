"""Operators of transactional dataflow and run analytics, as functions over DataFrames."""
