"""Bytes to rows: pure functions over bytes, used by the capture source in grouped Arrow steps."""
