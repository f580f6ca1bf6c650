"""A PySpark-native engine for simulation-grounded question-answer datasets."""
