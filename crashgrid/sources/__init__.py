"""Table readers, document listings and table maintenance."""
