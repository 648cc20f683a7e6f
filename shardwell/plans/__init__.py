"""Requests to plans, in plain Python, before any DataFrame exists."""
