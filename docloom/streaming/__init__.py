"""Micro-batch forms of the change pipeline."""
