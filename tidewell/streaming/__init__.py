"""Streams: folds by key with state, counts by window with watermarks."""
