"""Stateful streams: ordered operators over rows in order (``wraps``) and out of order within a bound (``ordered``), and progress."""
