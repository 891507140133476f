"""State between runs."""

from lawtide.state.tables import MonitorState

__all__ = ["MonitorState"]
