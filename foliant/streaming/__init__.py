"""Run logs as streams: an addition to the batch operators."""
