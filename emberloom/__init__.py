"""Event-fusion analytics and corpus preparation as Spark DataFrame operators."""
