"""Whole jobs: scorecards, reports and feature tables built from the operators."""
