"""Tables as event logs, and a streaming source over a log."""
