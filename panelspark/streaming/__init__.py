"""Event streams: availability, windows, first arrivals, keyed forecasters."""
