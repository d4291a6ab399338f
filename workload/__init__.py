"""Queries over the driver's tables: one per operator, with the SQL that gives the same rows."""
