"""Registered queries, each an operator applied to the tables of a folder."""
