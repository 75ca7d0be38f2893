"""Captured inputs to samples: exposition text, host snapshots, remote-write bodies, delta JSON, tables."""
