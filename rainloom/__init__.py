"""Rainloom: storm-track and rainfall analytics on Spark DataFrames."""
