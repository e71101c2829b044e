"""Whole jobs, and helpers that keep hot keys out of single tasks."""
