"""Posting analytics as DataFrame operators, with an explicit clock."""
