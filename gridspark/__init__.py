"""gridspark: decomposes spreadsheet workbooks into reviewable tables with PySpark, without evaluating any formula."""
