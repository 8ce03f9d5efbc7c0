"""Style, settings and polygon files: small files, read on the driver."""

from __future__ import annotations

import gzip
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from mapweave.operators.extract import Area


@dataclass(frozen=True)
class Style:
    """Which tag keys matter, and how: sets of keys."""

    node: frozenset[str]
    way: frozenset[str]
    poly: frozenset[str]
    feature: frozenset[str]
    types: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[dict]) -> Style:
        """From entries ``Tag, IsNode, IsWay, IsPoly, Type, IsFeature``; of a repeated tag the last counts."""
        last = {r["Tag"]: r for r in rows if r.get("Tag")}
        pick = lambda k, v: frozenset(t for t, r in last.items() if r.get(k) == v)
        return Style(pick("IsNode", True), pick("IsWay", True), pick("IsPoly", "yes"), pick("IsFeature", True), {t: r.get("Type") or "" for t, r in last.items()})


def read_style_file(path: str) -> Style:
    with open(path, encoding="utf-8") as f:
        return Style.of(json.load(f))


def style_from_table(df: DataFrame) -> Style:
    """From a table ``tag, is_node, is_way, is_poly, tag_type, is_feature``: a style is a few hundred rows at most."""
    rows = df.select("tag", "is_node", "is_way", "is_poly", "tag_type", "is_feature").collect()
    return Style.of([{"Tag": r[0], "IsNode": r[1], "IsWay": r[2], "IsPoly": r[3], "Type": r[4], "IsFeature": r[5]} for r in rows])


def parse_poly(text: str) -> Area:
    """A polygon filter: a name, then rings of ``lon lat`` lines ended by END; a label that starts with ! is a hole."""
    lines = [x.strip() for x in text.splitlines()]
    rings, holes, i = [], [], 1
    while i < len(lines) and lines[i] != "END":
        label, i = lines[i], i + 1
        if not label:
            continue
        ring = []
        while i < len(lines) and lines[i] != "END":
            if lines[i]:
                lon, lat = lines[i].split()[:2]
                ring.append((round(float(lon) * 1e7), round(float(lat) * 1e7)))
            i += 1
        i += 1
        (holes if label.startswith("!") else rings).append(ring)
    if not rings:
        raise ValueError("a polygon filter without rings")
    return Area(rings=rings, holes=holes)


def read_poly_file(path: str) -> Area:
    with open(path, encoding="utf-8") as f:
        return parse_poly(f.read())


@dataclass
class FileState:
    """One file of a data set: State, EndDate, Filename, NumTiles."""

    State: int
    EndDate: str
    Filename: str
    NumTiles: int = 0


def read_file_list(path: str) -> list[FileState]:
    with open(path, encoding="utf-8") as f:
        return [FileState(**{k: r[k] for k in ("State", "EndDate", "Filename", "NumTiles") if k in r}) for r in json.load(f)]


def write_file_list(path: str, files: list[FileState]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump([asdict(x) for x in files], f, indent=1)


def last_state(path: str) -> FileState | None:
    return max(read_file_list(path), key=lambda x: x.State, default=None)


@dataclass
class UpdateSettings:
    SourcePrfx: str = ""
    DiffsLocation: str = ""
    InitialState: int = 0
    RoundTime: bool = False
    LocationsCache: str = ""
    QuadtreeTuple: bool = False
    IncludeUnchangedNodes: bool = False


def read_update_settings(path: str) -> UpdateSettings:
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    return UpdateSettings(**{k: known[k] for k in UpdateSettings.__dataclass_fields__ if k in known})


def write_update_settings(path: str, settings: UpdateSettings) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=1)


def open_text(path: str):
    return gzip.open(path, "rt", encoding="utf-8") if path.endswith(".gz") else open(path, encoding="utf-8")
