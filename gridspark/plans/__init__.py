"""Operators put together: the workbook pipeline and the workbook view of ordinary tables."""
