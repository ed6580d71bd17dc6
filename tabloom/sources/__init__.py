"""Readers of files and external sources, and the store the hub publishes tables to."""
