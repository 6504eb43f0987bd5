"""Whole plans: searches, the service, the registered queries."""
