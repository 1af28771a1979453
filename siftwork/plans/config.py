"""Settings of a mining run, checked when made."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field

GRANULARITIES = ("afs", "afs.bb1", "afs.bb2")
DEPENDENCIES = ("", "ODD", "CDD")
INCONSISTENCY_TYPES = ("all", "check", "store", "call", "type", "order")
ALGORITHMS = ("cc", "dbscan", "dbscancos", "aff", "affcos", "means", "lda")

# The verbs whose calls are looked for, the casts and the stored values, by default.
CALL_VERBS = ("free", "close", "memset", "clear", "bzero", "remove", "unlock", "end", "clean", "cleanse", "assert")
TYPE_CASTS = ("trunc",)
STORED_VALUES = ("null",)


def csv(value: str) -> tuple[str, ...]:
    """A comma list; the empty string has no items."""
    return tuple(x.strip() for x in value.split(",") if x.strip())


@dataclass(frozen=True)
class Step:
    """A clustering step: features, algorithm and threshold, such as Step("NN", "cc", 0.95)."""

    features: str
    algorithm: str
    threshold: float

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm}")

    @classmethod
    def parse(cls, features: str, algorithm: str) -> Step:
        """From "afs_NN" and "cc_0.95"."""
        name, _, threshold = algorithm.rpartition("_")
        return cls(features.rpartition("_")[2], name, float(threshold))


@dataclass(frozen=True)
class Config:
    projects: tuple[str, ...] = ()
    granularity: tuple[str, ...] = GRANULARITIES
    dependency: str = ""
    first: Step = field(default_factory=lambda: Step("NN", "cc", 0.95))
    second: Step = field(default_factory=lambda: Step("G2v", "cc", 0.98))
    big_clusters: int = 50
    chunk_window: int = 1
    inconsistency_type: str = "check"
    similarity_threshold: float = 0.7
    filtering: bool = True
    call_verbs: tuple[str, ...] = CALL_VERBS
    type_casts: tuple[str, ...] = TYPE_CASTS
    stored_values: tuple[str, ...] = STORED_VALUES
    starting_item: int = 1

    def __post_init__(self):
        if self.dependency.upper() not in DEPENDENCIES:
            raise ValueError(f"unknown dependency {self.dependency}")
        if unknown := set(self.granularity) - set(GRANULARITIES):
            raise ValueError(f"unknown granularity {sorted(unknown)}")
        if self.inconsistency_type not in INCONSISTENCY_TYPES:
            raise ValueError(f"unknown inconsistency type {self.inconsistency_type}")
        if self.chunk_window == 0 or self.chunk_window < -1:
            raise ValueError("the chunk window is -1 (none) or at least 1")
        if self.big_clusters < 2:
            raise ValueError("clusters have two members at least")

    @classmethod
    def parse(cls, arguments: Sequence[str]) -> Config:
        """From command-line flags; lists are separated by commas. Unknown flags and values end the program with a message."""
        flags = argparse.ArgumentParser(prog="siftwork", description="Settings of a mining run.")
        flags.add_argument("-p", "--projects", type=csv, default=())
        flags.add_argument("-g", "--granularity", type=csv, default=GRANULARITIES)
        flags.add_argument("-d", "--dependency", default="")
        flags.add_argument("--first", nargs=2, metavar=("FEATURES", "ALGORITHM"), default=("afs_NN", "cc_0.95"), help="such as afs_NN cc_0.95")
        flags.add_argument("--second", nargs=2, metavar=("FEATURES", "ALGORITHM"), default=("afs_G2v", "cc_0.98"))
        flags.add_argument("--big-clusters", type=int, default=50)
        flags.add_argument("--chunk-window", type=int, default=1)
        flags.add_argument("-t", "--inconsistency-type", default="check", choices=INCONSISTENCY_TYPES)
        flags.add_argument("-s", "--similarity-threshold", type=float, default=0.7)
        flags.add_argument("--no-filtering", dest="filtering", action="store_false")
        flags.add_argument("--call-verbs", type=csv, default=CALL_VERBS)
        flags.add_argument("--type-casts", type=csv, default=TYPE_CASTS)
        flags.add_argument("--stored-values", type=csv, default=STORED_VALUES)
        flags.add_argument("--starting-item", type=int, default=1)
        found = vars(flags.parse_args(list(arguments)))
        try:
            return cls(**found | {step: Step.parse(*found[step]) for step in ("first", "second")})
        except ValueError as error:
            flags.error(str(error))
