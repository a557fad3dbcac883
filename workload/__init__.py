"""Queries over the driver tables, with an SQL text for each where SQL can say it."""
