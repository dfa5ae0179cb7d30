"""Index configurations: five axes and their short and long identifiers."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


# The members of the five axes and their letters in identifiers.


class Info(Enum):
    """What a posting holds: positions; also their count; also the document's length, for weights."""

    BOOLEAN = "1"
    WORDCOUNT = "2"
    TFIDF = "3"


class Store(Enum):
    """How an index is kept: Parquet files, a catalog table bucketed by term, or (as 1) Parquet files."""

    CUSTOM = "1"
    DB1 = "2"
    DB2 = "3"


class Codec(Enum):
    """Compression of the stored index."""

    NONE = "1"
    CODE = "2"
    CLIB = "3"


class Evaluation(Enum):
    """Boolean retrieval, or ranked retrieval over the bag of terms."""

    TERM = "T"
    DOC = "D"


class Optimization(Enum):
    NONE = "0"
    SKIPPING = "sp"
    THRESHOLDING = "th"
    EARLY_STOPPING = "es"


#: Parquet writer options of each codec: plain pages; dictionaries with bit-packed run lengths; DEFLATE.
PARQUET = {
    Codec.NONE: {"compression": "uncompressed", "parquet.enable.dictionary": "false"},
    Codec.CODE: {"compression": "uncompressed", "parquet.enable.dictionary": "true"},
    Codec.CLIB: {"compression": "gzip"},
}


@dataclass(frozen=True)
class IndexConfig:
    """``info`` decides what postings are stored with, ``store`` where.

    ``optimization`` means: SKIPPING adds skip targets to the stored postings; THRESHOLDING drops
    scores below ``least_score``; EARLY_STOPPING stops looking for documents once ``most_hits``
    are certain: ranked retrieval takes the terms from the rarest on and scores only documents
    of the first ones that promise so many, Boolean retrieval returns the first ones it meets.
    """

    core: str = "SelfIndex"
    info: Info = Info.TFIDF
    store: Store = Store.CUSTOM
    codec: Codec = Codec.NONE
    evaluation: Evaluation = Evaluation.TERM
    optimization: Optimization = Optimization.NONE
    least_score: float = 0.0
    most_hits: int = 100

    def __post_init__(self) -> None:
        if self.core not in ("SelfIndex", "ESIndex"):
            raise ValueError(f"unknown core {self.core}")

    @classmethod
    def of(cls, core: str, info: str, store: str, evaluation: str, codec: str, optimization: str) -> IndexConfig:
        """From names of the enums' members."""
        return cls(core, Info[info], Store[store], Codec[codec], Evaluation[evaluation], Optimization[optimization])

    @property
    def short_id(self) -> str:
        return f"{self.core}_i{self.info.value}d{self.store.value}c{self.codec.value}q{self.evaluation.value}o{self.optimization.value}"

    @property
    def long_id(self) -> str:
        axes = {"index": self.info, "datastore": self.store, "compressor": self.codec, "qproc": self.evaluation, "optim": self.optimization}
        return "|".join([f"core={self.core}", *(f"{k}={v.name}" for k, v in axes.items())])
