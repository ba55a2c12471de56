"""Downloads of label shards, apart from the engine: a listing, then each file once."""

from __future__ import annotations

import json
import urllib.request
from pathlib import Path
from urllib.parse import urljoin

BLOCK = 1 << 20


def listed(url: str, seconds: float = 30.0) -> list[str]:
    """Links of a JSON listing: a list of links, or of objects with ``url`` or ``path``, those relative to the listing."""
    with urllib.request.urlopen(url, timeout=seconds) as reply:  # noqa: S310  the caller names the place
        found = json.loads(reply.read())
    links = [x if isinstance(x, str) else x.get("url") or x["path"] for x in found]
    return sorted(urljoin(url, x) if "://" not in x else x for x in links if x.endswith(".parquet"))


def fetched(url: str, folder: str, seconds: float = 300.0) -> tuple[Path, bool]:
    """The file in the folder, and whether it was fetched now; one that is there already is left alone.

    It gets its name only when it is whole, so a broken download is begun anew.
    """
    place = Path(folder, url.rstrip("/").rsplit("/", 1)[1])
    if place.exists():
        return place, False
    place.parent.mkdir(parents=True, exist_ok=True)
    part = place.with_name(place.name + ".part")
    with urllib.request.urlopen(url, timeout=seconds) as reply, part.open("wb") as out:  # noqa: S310
        want = reply.headers.get("Content-Length")
        while block := reply.read(BLOCK):
            out.write(block)
    if want is not None and part.stat().st_size != int(want):
        raise OSError(f"{url}: {part.stat().st_size} bytes instead of {want}")
    part.replace(place)
    return place, True


def fetch_all(listing: str, folder: str) -> list[Path]:
    return [fetched(url, folder)[0] for url in listed(listing)]
