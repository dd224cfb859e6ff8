"""Readers and writers of ticket tables."""

from ticketlens.sources.sinks import write_themes, write_tickets
from ticketlens.sources.tickets import (
    apply_aliases,
    ensure_columns,
    merge_text_dates,
    normalize_tickets,
    read_tickets_csv,
    with_ticket_id,
)

__all__ = [
    "apply_aliases",
    "ensure_columns",
    "merge_text_dates",
    "normalize_tickets",
    "read_tickets_csv",
    "with_ticket_id",
    "write_themes",
    "write_tickets",
]
