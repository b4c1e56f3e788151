"""quirelake: a Spark-first engine that turns semi-structured documents into relations."""
