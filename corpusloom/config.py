"""Thresholds of the rule sets and windows; defaults are the reference's."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Quality:
    min_tokens: int = 1
    max_tokens: int = 60
    min_chars: int = 1
    max_chars: int = 300
    max_token_length: int = 30
    min_alpha: float = 0.6
    max_digit: float = 0.2
    max_non_alnum: float = 0.2
    max_repeat: int = 6
    min_unique: float = 0.3


#: For whole documents: the defaults are tuned for short captions, which nearly every document exceeds.
DOCUMENTS = Quality(min_tokens=10, max_tokens=20_000, max_chars=200_000, max_token_length=40, max_non_alnum=0.3, min_unique=0.2)


@dataclass(frozen=True)
class Visual:
    min_face_rate: float = 0.7
    min_lip_size: float = 0.03
    min_openness: float = 0.004
    min_motion: float = 0.003
    max_motion: float = 0.08
    min_sharpness: float = 10.0


@dataclass(frozen=True)
class Accent:
    min_rms: float = -45.0
    min_active: float = 0.08
    min_english: float = 0.80
    min_score: float = 0.62
    min_margin: float = 0.10
    min_votes: float = 0.50


@dataclass(frozen=True)
class Windows:
    clip: float = 2.0
    stride: float = 1.0
    context: float = 0.0
    min_words: int = 1
    max_words: int = 16
    gap: float = 0.5
    pad: float = 0.25
    min_overlap: float = 0.25


#: As the reference has them where it names a default.
@dataclass(frozen=True)
class Sampling:
    samples: int = 12
    first: float = 0.08
    last: float = 0.92
    fps: int = 30
    half: int = 15
    clip: float = 6.0
    clips: int = 4
    bins: int = 5
    strided: int = 16
    stride: int = 3
    sigma: float = 1.0
    least_confidence: float = 0.2
    ramp: int = 20
    most_augmentation: float = 0.5
    frame: int = 10
    least_db: float = -35.0
    skip: int = 4


@dataclass(frozen=True)
class Speaker:
    min_track: float = 0.45
    min_good: float = 0.30
    min_primary: float = 0.70
    min_motion: float = 0.020
    min_open: float = 0.12
    rival_ratio: float = 0.70
    min_rival: float = 0.20


@dataclass(frozen=True)
class FullVideo:
    min_face_rate: float = 0.65
    min_good_rate: float = 0.45
    max_ambiguous: float = 0.35
    min_mouth_width: float = 28.0
    min_height: float = 0.16
    max_yaw: float = 0.46
    min_segments: int = 1


@dataclass(frozen=True)
class SampleFilter:
    max_words: int = 400
    max_units: int = 1200
    max_frames: int = 1000
    min_confidence: float = 0.2
