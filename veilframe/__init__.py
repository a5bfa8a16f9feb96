"""A PySpark engine for policy-driven de-identification of medical-imaging records."""
