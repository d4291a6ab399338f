"""Readers and writers for exports, dictionaries, queries, tables and files."""
