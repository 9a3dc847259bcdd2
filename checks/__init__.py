"""Queries over the given tables and the SQL that states what each must return."""
