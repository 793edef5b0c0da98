"""Vocabulary layout and session defaults."""

from __future__ import annotations

import os
import tempfile
import zipfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Vocabulary:
    """How text and audio ids share one vocabulary. Literals of it fold into plans."""

    # The layout that token ids of trained models depend on.
    codebooks: int = 8
    codebook_size: int = 2048
    text_size: int = 50257
    total: int = 70016
    convert: str = "[convert]"
    go_on: str = "[continue]"
    text: str = "[text]"
    audio: str = "[mimi]"
    unknown_speaker: str = "[spkr_unk]"
    stop: str = "[stop]"

    @property
    def audio_offset(self) -> int:
        return self.text_size

    @property
    def audio_size(self) -> int:
        return self.codebooks * self.codebook_size

    @property
    def spare(self) -> int:
        """Ids that neither text nor audio takes: task, modality, speaker and stop tokens are among them."""
        return self.total - self.text_size - self.audio_size


VOCABULARY = Vocabulary()
#: The older layout: two codebooks of 1024 codes, interleaved.
TWO_BOOKS = Vocabulary(codebooks=2, codebook_size=1024)
SAMPLE_RATE = 24_000


def session(name: str = "auralake", **conf: str) -> SparkSession:
    """A session with what the library relies on: UTC, adaptive execution, Arrow transfer, and workers that have this package."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
    spark = SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application: they need not run where it is installed."""
    app, here = spark.sparkContext.applicationId, os.path.dirname(os.path.abspath(__file__))
    if app in _shipped or not os.path.isdir(here):
        return
    _shipped.add(app)
    path = os.path.join(tempfile.mkdtemp(), "auralake_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("auralake", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
