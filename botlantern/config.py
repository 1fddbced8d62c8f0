"""Settings of the engine, with their defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

MODES = ("disabled", "recent", "full")
#: field: (least, most)
BOUNDS = {
    "recent_day_count": (1, 365),
    "log_watch_interval_ms": (5_000, 3_600_000),
    "historical_import_days": (1, 365),
    "max_recent_files": (1, 1024),
    "max_historical_files_per_batch": (1, 5000),
    "max_bytes_per_file_per_cycle": (64 << 10, 64 << 20),
    "log_read_chunk_bytes": (4 << 10, 16 << 20),
    "log_read_batch_lines": (50, 50_000),
    "max_scan_duration_ms": (5_000, 1_800_000),
}


@dataclass(frozen=True)
class Config:
    stats_interval_ms: int = 600_000
    recent_day_count: int = 90
    log_directory: str = ""
    enable_ai_stats: bool = True
    enable_image_stats: bool = True
    default_model: str | None = None
    tracked_sources: dict[str, bool] = field(default_factory=lambda: {"yesimbot": True, "image-generator": True, "chat-luna": True})
    log_watch_interval_ms: int = 60_000
    historical_import_mode: str = "recent"
    historical_import_days: int = 30
    max_recent_files: int = 64
    max_historical_files_per_batch: int = 500
    max_bytes_per_file_per_cycle: int = 8 << 20
    log_read_chunk_bytes: int = 1 << 20
    log_read_batch_lines: int = 1000
    max_scan_duration_ms: int = 120_000

    def __post_init__(self) -> None:
        for name, (least, most) in BOUNDS.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be from {least} to {most}")
        if self.historical_import_mode not in MODES:
            raise ValueError(f"historical_import_mode must be one of {', '.join(MODES)}")

    @property
    def default_period(self) -> int:
        """The period whose figures stand at the top of the dashboard."""
        return self.recent_day_count if self.recent_day_count in (7, 30, 90) else 90
