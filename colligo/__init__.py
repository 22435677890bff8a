"""Colligo: catalogue reconciliation as lazy Spark DataFrame functions."""
