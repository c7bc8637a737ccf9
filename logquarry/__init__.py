"""Log analytics on Spark: parse, enrich, search, aggregate, alert, analyse and retain operational logs."""

from logquarry.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
