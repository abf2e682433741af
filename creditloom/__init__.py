"""Corporate credit appraisal of many companies at once, as Spark jobs."""
