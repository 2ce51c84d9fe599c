"""Logs as streams: recording with dense offsets, tailing, and acknowledgement frontiers."""
