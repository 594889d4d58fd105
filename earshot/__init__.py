"""Listening analytics on Spark: DataFrame operators and reports for play-event logs."""
