"""tallyloom: retail audit, KPI, diagnostic and forecast operators on Spark DataFrames."""
