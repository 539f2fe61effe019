"""Readers and flatteners: files and feed messages to typed rows."""
