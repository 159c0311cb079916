"""Readers and writers for audit logs, command files and stored data sets."""
