"""Ticket operators, all `DataFrame -> DataFrame`."""
