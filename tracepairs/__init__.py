"""Preference-pair analytics over reasoning traces, as Spark DataFrame plans."""
