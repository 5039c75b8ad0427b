"""Operators over version logs and their live snapshots."""
