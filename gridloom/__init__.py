"""gridloom: Spark-native load and flexibility analytics over large hourly telemetry."""
