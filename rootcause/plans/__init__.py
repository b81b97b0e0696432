"""Declarative plan tables: diagnostics per theme, classification lexicons."""
