"""terradelta: change-detection analytics over scene, chip, pixel and vector tables, as Spark jobs."""
