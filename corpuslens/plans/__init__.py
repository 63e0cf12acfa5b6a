"""Registered queries: operators over the driver tables, each with its SQL equivalent."""
