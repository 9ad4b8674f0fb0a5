"""Retail sales warehouse and KPI marts, written as Spark DataFrame jobs."""
