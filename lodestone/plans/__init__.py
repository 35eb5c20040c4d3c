"""Queries over the test tables, built from the operators, with the SQL that states each."""
