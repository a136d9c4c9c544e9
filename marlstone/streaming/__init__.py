"""Structured Streaming forms of the replays: windows, limits and incremental change detection."""
