"""DataFrame -> DataFrame operators over samples, points, rollups and alerts."""
