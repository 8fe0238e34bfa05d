"""Views over the test tables, the query registry and its oracle SQL."""
