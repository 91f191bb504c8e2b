"""Scriptorium: a PySpark-native engine for cleaning, resolving and de-duplicating bibliographic metadata."""
