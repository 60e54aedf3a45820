"""Query plans: the ETL stages and the analyses, as DataFrame functions."""
