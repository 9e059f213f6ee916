"""Relational and numeric operators over points."""
