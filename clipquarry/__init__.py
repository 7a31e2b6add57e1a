"""Clipquarry: analytics over timed transcripts and candidate moments, on Spark."""
