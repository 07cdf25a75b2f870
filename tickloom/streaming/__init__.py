"""Event streams: watermarked windows and per-series state."""
