"""Literature analytics and training-data preparation as Spark DataFrame operators."""
