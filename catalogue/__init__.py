"""Every operator as a named query over the given tables, with its SQL twin."""

from catalogue import charts, cleaning, personal, profiling, storage, streams
from catalogue.base import Entry


def entries() -> dict[str, Entry]:
    found: dict[str, Entry] = {}
    for part in (cleaning, profiling, charts, personal, storage, streams):
        for name, entry in part.ENTRIES.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = entry
    return found
