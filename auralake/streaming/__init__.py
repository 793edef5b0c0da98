"""Continuous forms of the request metrics, logs, feedback and load."""
