"""Incremental forms of two batch operators (Structured Streaming).

The reference is batch only; these run the *same* definitions over a
stream of half-hourly readings: hourly sums (A4) with a tumbling window,
and rain periods (W1) with a session window keyed by year (periods reset
each year; a gap of exactly the session gap joins, anything longer splits).
Late readings are bounded by a watermark.
"""

from rainfold.streaming.rain_stream import hourly_rain_stream, rain_periods_stream

__all__ = ["hourly_rain_stream", "rain_periods_stream"]
