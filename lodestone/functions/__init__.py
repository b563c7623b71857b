"""Part of the search engine: functions."""
