"""Streaming views of an event table.  Beyond what the batch operators need; same functions for both."""
