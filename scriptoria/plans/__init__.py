"""Registered queries, their SQL, and the plans that compile a knowledge package."""
