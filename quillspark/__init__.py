"""Wiki markup at corpus scale: parse pages into a token table and query it with Spark."""
