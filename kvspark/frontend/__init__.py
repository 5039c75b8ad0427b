"""Edges where results are collected: feature flags, tokens, command line, HTTP."""
