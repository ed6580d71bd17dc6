"""Tabloom: a governed hub of tables built from Spark DataFrames.

Operators take DataFrames and return DataFrames.  Nothing is executed until the caller runs an action; the few
functions that must run one (writing a table version, checking keys, reading a watermark) say so.
"""
