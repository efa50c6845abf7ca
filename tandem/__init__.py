"""Co-change analytics over ordered basket histories, on PySpark."""
