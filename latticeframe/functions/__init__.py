"""Part of the keyed-table engine."""
