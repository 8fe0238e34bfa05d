"""Column expressions, name rules and candidate lists. No Spark job starts here."""
