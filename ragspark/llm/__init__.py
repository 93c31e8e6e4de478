"""Operators of a training-data pipeline: each is a Spark job over whole tables of documents."""
