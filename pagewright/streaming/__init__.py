"""Stateful hosts of the conversation."""
