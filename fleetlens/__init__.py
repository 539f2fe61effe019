"""fleetlens: Spark-first analytics over public-transport schedules and vehicle feeds."""
