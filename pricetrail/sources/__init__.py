"""Inputs: captured pages, reference lists, stored tables and the supplied test tables."""
