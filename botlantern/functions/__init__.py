"""Column functions: time, text and safe arithmetic."""

from .text import first_filled, first_name, infer_provider_chat, infer_provider_model, infer_source, last_segment, log_file_key, strip_ansi, utf16_length
from .time import closed_past, day_label, day_number, day_of_ms, hour_of_ms, instant_of_ms, open_ended
from .values import ratio, whole

__all__ = [
    "closed_past", "day_label", "day_number", "day_of_ms", "first_filled", "first_name", "hour_of_ms", "infer_provider_chat", "infer_provider_model",
    "infer_source", "instant_of_ms", "last_segment", "log_file_key", "open_ended", "ratio", "strip_ansi", "utf16_length", "whole",
]
