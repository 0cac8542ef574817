"""Registered queries over the benchmark tables, each next to the SQL that checks it."""
