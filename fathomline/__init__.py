"""Fathomline: disclosure analytics and corpus preparation on Spark."""
