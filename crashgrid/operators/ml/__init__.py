"""Features, severity model, anomaly detection."""
