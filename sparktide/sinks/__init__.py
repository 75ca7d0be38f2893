"""Outputs: lake table, exposition text, matrix JSON, series batches, alert payloads, fan-out."""
