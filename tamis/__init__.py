"""Query-aware subset selection over paired embedding tables, on Spark DataFrames."""
