"""Registered queries and the oracle SQL that checks them."""
