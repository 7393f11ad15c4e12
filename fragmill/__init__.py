"""Content-addressed, versioned, redundantly coded data as Spark relations."""
