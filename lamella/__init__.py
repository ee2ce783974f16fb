"""lamella: analytics over Apache Parquet files, declared with the Spark DataFrame and SQL API."""
