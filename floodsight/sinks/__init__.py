"""Writers: alarm logs, time-series points, captured packets."""
