"""touchline: match-event and pass-difficulty analytics as Spark jobs."""

from touchline.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
