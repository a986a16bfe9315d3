"""Central constants; importing this has no effect on any file."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    seed: int = 42
    threshold: float = 0.5
    #: tokens that a language model reads at once, and by which its window moves on
    lm_window: int = 1024
    lm_stride: int = 512
    #: words, by white space, of a generated essay, a paragraph to rework, a reworked one and a sentence
    essay_words: int = 80
    rework_words: int = 15
    reworked_words: int = 8
    sentence_words: int = 3
    batch: int = 8


CONFIG = Config()
