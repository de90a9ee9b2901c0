"""Jobs that chain operators: ETL, reports, suites."""
