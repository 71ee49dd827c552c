"""Readers of workbooks."""
