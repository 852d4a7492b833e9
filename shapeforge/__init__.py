"""Spark jobs that check corpora of XML report packages and the graphs made from them."""
