"""Conversation preparation and grouped vector transforms as Spark DataFrame jobs."""
