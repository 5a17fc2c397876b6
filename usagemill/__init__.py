"""Usage-report analytics as Spark jobs: read, clean, profile, measure, route and ingest."""
