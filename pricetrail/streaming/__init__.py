"""Delivery of observations as a stream: the batch operators, run per micro-batch."""
