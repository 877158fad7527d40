"""Settings: defaults, limits, and reading them from their JSON."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CORES = os.cpu_count() or 1


# The names and defaults below, which stored settings refer to.
@dataclass(frozen=True)
class Settings:
    inference_threads: int = max(1, _CORES // 2)
    worker_threads: int = min(4, max(1, -(-_CORES // 2)))
    detection_threshold: float = 0.5
    detection_nms_threshold: float = 0.4
    detection_input_size: int = 640
    max_faces_per_image: int = 64
    analysis_max_dim: int = 1600
    recognition_threshold: float = 0.42
    recognition_margin: float = 0.05
    unique_person_per_frame: bool = True
    auto_confirm_above: float = 1.0
    cluster_edge_threshold: float = 0.45
    cluster_min_size: int = 3
    cluster_merge_threshold: float = 0.62
    cluster_neighbours: int = 12
    video_enabled: bool = True
    video_scene_threshold: float = 0.3
    video_sample_interval: float = 5.0
    video_max_frames: int = 60
    scan_recursive: bool = True
    ffmpeg_directory: str | None = None
    detector_model: str | None = None
    embedder_model: str | None = None

    def sanitised(self) -> Settings:
        """Every number within its limits; the detector's size a multiple of 32."""
        new = {k: type(getattr(self, k))(min(hi, max(lo, getattr(self, k)))) for k, (lo, hi) in LIMITS.items()}
        new["detection_input_size"] = new["detection_input_size"] // 32 * 32
        return dataclasses.replace(self, **new)


# The limits of numbers.
LIMITS = {
    "inference_threads": (1, _CORES), "worker_threads": (1, _CORES), "detection_threshold": (0.05, 0.99), "detection_nms_threshold": (0.1, 0.9), "detection_input_size": (320, 1280), "max_faces_per_image": (1, 256),
    "analysis_max_dim": (640, 4096), "recognition_threshold": (0.1, 0.99), "recognition_margin": (0.0, 0.5), "auto_confirm_above": (0.0, 1.0), "cluster_edge_threshold": (0.1, 0.99), "cluster_min_size": (1, 100),
    "cluster_merge_threshold": (0.1, 1.0), "cluster_neighbours": (2, 64), "video_scene_threshold": (0.05, 0.95), "video_sample_interval": (0.0, 600.0), "video_max_frames": (1, 1000),
}


def raw_setting(settings: DataFrame, key: str) -> str | None:
    row = settings.where(F.col("key") == key).select("value").first()
    return row["value"] if row else None


def setting(settings: DataFrame, key: str, default):
    """The value of a key; the default if there is none or it isn't JSON."""
    raw = raw_setting(settings, key)
    try:
        return default if raw is None else json.loads(raw)
    except ValueError:
        return default


def all_settings(settings: DataFrame) -> dict[str, str]:
    return {r["key"]: r["value"] for r in settings.select("key", "value").collect()}


def load_settings(settings: DataFrame, key: str = "app") -> Settings:
    """Settings within limits; unknown keys are ignored, values of a wrong kind get their default."""
    found = setting(settings, key, {})
    plain = Settings()
    kinds = {f.name: type(getattr(plain, f.name)) for f in dataclasses.fields(Settings)}

    def fits(name: str, v) -> bool:
        if kinds[name] is type(None):
            return v is None or isinstance(v, str)
        return isinstance(v, kinds[name]) and isinstance(v, bool) == (kinds[name] is bool) or kinds[name] is float and isinstance(v, int) and not isinstance(v, bool)

    if not isinstance(found, dict):
        return plain.sanitised()
    return dataclasses.replace(plain, **{k: v for k, v in found.items() if k in kinds and fits(k, v)}).sanitised()
