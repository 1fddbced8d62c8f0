"""Sources: rotating JSON-lines log directories, for batch and streaming, and stored tables."""

from .logs import BotLogSource, LogFile, discover_after, discover_recent, read_lines

__all__ = ["BotLogSource", "LogFile", "discover_after", "discover_recent", "read_lines"]
