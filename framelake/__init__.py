"""Spark-native analysis of block-coded video streams and the measurements on them."""
