"""Sonaril: a PySpark library for audio streams as relational data."""
