"""DataFrame operators; every one takes its columns and thresholds as arguments."""
