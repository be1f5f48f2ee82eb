"""Column helpers and the ordered scans that operators share."""
