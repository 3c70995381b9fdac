"""Spark-native shaping of hospital-warehouse extracts: payload flattening, date and token parsing, batched fetches."""
