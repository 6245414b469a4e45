"""Row-local steps over unbounded sources."""
