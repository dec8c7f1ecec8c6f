"""Readers and writers: counts, dense tables, lists, graphs, links, manifests."""
