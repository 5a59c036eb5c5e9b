"""Training-data operators; nothing outside this folder imports it."""
