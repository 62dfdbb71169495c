"""Structured Streaming: usage events in, sessions as they close. Each has a batch twin that tests hold it against."""
