"""Readers and writers: repositories, documents, graphs, snapshots."""
