"""Storage levels by name."""

from __future__ import annotations

from pyspark import StorageLevel

#: Disk, memory, off-heap, deserialised, copies. Fixed values.
_LEVELS = {
    "NONE": (False, False, False, False, 1), "DISK_ONLY": (True, False, False, False, 1), "DISK_ONLY_2": (True, False, False, False, 2),
    "DISK_ONLY_3": (True, False, False, False, 3), "MEMORY_ONLY": (False, True, False, True, 1), "MEMORY_ONLY_2": (False, True, False, True, 2),
    "MEMORY_ONLY_SER": (False, True, False, False, 1), "MEMORY_ONLY_SER_2": (False, True, False, False, 2), "MEMORY_AND_DISK": (True, True, False, True, 1),
    "MEMORY_AND_DISK_2": (True, True, False, True, 2), "MEMORY_AND_DISK_SER": (True, True, False, False, 1), "MEMORY_AND_DISK_SER_2": (True, True, False, False, 2),
    "OFF_HEAP": (False, True, True, False, 1),
}


def parse_level(name: str) -> StorageLevel:
    """Any case; an unknown name is an error."""
    try:
        return StorageLevel(*_LEVELS[name.strip().upper()])
    except KeyError:
        raise ValueError(f"unknown storage level {name}") from None
