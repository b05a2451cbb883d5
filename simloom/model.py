"""Schemas of the engine's tables and its options."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Assets as they are stored; segments have a table of their own, of which prints has a fingerprint by type.
ASSETS = "asset_key long, iscc_id string, realm int, iscc_code string, units array<string>, metadata string, prints map<string,string>"
#: One row an asset and unit; w0..w3 are the body's 64-bit words.
UNITS = "asset_key long, unit_type string, nbits int, w0 long, w1 long, w2 long, w3 long, body binary"
#: One row an asset and segment; lead marks the one at its place that searches for near segments look at.
SEGMENTS = "asset_key long, sp_type string, sp binary, offset long, size long, w0 long, w1 long, w2 long, w3 long, lead boolean"
#: Segments as entries bring them.
ENTRY_SIMPRINTS = "array<struct<sp_type:string,simprint:string,offset:bigint,size:bigint>>"
#: Asset files as they come.
ASSET_FILE = (
    "iscc_id string, iscc_code string, iscc string, units array<string>, name string, "
    "features array<struct<maintype:string, subtype:string, version:int, simprints:array<string>, offsets:array<long>, sizes:array<long>>>, corrupt_ string"
)

MODES = ("exact", "prefix", "similarity")
NEAREST = ("exact", "banded")


@dataclass(frozen=True)
class Options:
    """The default thresholds and factors."""

    mode: str = "similarity"
    #: How nearest codes and segments are looked for.
    nearest: str = "exact"
    threshold_units: float = 0.75
    threshold_simprints: float = 0.75
    exponent: int = 4
    oversampling: int = 20
    dup_limit: int = 1000
    limit: int = 100
    flush_rows: int = 100_000
    poll_seconds: int = 60
    hub_refresh_seconds: int = 3600
    #: Queries that are broadcast at once; more are matched block by block.
    query_block: int = 10_000
    #: Buckets an index is cut into when it is made.
    buckets: int = 16
    #: Bundles of a log that are read in one poll of a hub.
    poll_bundles: int = 1000

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.nearest not in NEAREST:
            raise ValueError(f"nearest must be one of {NEAREST}")
        for name in ("threshold_units", "threshold_simprints"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        for name in ("exponent", "oversampling", "dup_limit", "limit", "flush_rows", "query_block", "buckets", "poll_bundles"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    def override(self, **changes) -> Options:
        """A validated copy with changes."""
        return replace(self, **changes)
