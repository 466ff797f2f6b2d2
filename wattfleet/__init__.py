"""Spark operators for fleets of electrical energy meters."""

from wattfleet.session import get_session, prepare

__all__ = ["get_session", "prepare"]
