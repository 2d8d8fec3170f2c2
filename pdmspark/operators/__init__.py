"""Operators that join, order, group, sample and model tables."""
