"""Palisade: security analytics over request, event, packet, flow and payload tables on Spark."""

__version__ = "0.1.0"
