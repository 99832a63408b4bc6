"""Readers and writers: clips, packet streams, and views over the test tables."""
