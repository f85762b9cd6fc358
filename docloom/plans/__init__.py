"""Canonical tables and registered queries."""
