"""Imports every module that registers queries."""

from . import admin_queries, cycle_queries, place_queries, service_queries, stream_queries, text_queries  # noqa: F401
