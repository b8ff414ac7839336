"""Checks against an independent SQL engine: fixture mapping, registered queries and their SQL."""
