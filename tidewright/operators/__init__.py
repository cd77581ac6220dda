"""Operators over ordered events: windows, joins, tables, patterns and the rest."""
