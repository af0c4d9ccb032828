"""Registered queries. Importing the family modules fills the tables."""

from listingflow.catalog import fields, jobs, payloads, tables
from listingflow.catalog.core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "fields", "jobs", "payloads", "tables"]
