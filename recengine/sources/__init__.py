"""Readers of events, metadata and vectors, and the logical views the queries run on."""
