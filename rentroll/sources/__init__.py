"""CSV scans, stored tables and the file manifest."""
