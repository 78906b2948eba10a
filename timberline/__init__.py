"""Log analytics as Spark jobs: raw text lines in, triaged incidents out."""

from timberline.session import build_session, cut, prepare, workspace

__all__ = ["build_session", "cut", "prepare", "workspace"]
