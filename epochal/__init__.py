"""A Spark-native engine for transactional dataflow, run analytics and corpus preparation."""
