"""heddle: change-history, dependency-graph and findings analytics as Spark DataFrame operators."""
