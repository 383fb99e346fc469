"""Readers, panels derived from tables, calendars, and writers."""
