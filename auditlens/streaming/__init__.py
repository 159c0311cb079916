"""Audit logs as a stream; every column function applies to it unchanged."""
