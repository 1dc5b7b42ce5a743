"""Content-addressed, versioned data as Spark tables."""
