"""Operators: functions from frames to frames, for use with `DataFrame.transform`."""
