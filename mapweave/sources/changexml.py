"""Change XML: create, modify and delete containers of nodes, ways and relations, in document order."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal
from typing import BinaryIO
from xml.etree.ElementTree import iterparse

SCHEMA = (
    "file_idx int, seq bigint, change tinyint, kind tinyint, id bigint, version bigint, ts bigint, changeset bigint, uid bigint, user string, visible boolean, "
    "tags array<struct<k:string,v:string>>, lon bigint, lat bigint, refs array<bigint>, members array<struct<type:tinyint,ref:bigint,role:string>>"
)
COLUMNS = ("change", "kind", "id", "version", "ts", "changeset", "uid", "user", "visible", "tags", "lon", "lat", "refs", "members")
_CHANGE = {"delete": 1, "modify": 4, "create": 5}
_KIND = {"node": 0, "way": 1, "relation": 2}


def parse_time(text: str | None) -> int | None:
    """Seconds from ``2006-01-02T15:04:05`` (a Z or offset may follow) or ``20060102``, in UTC."""
    if not text:
        return None
    if len(text) == 8 and text.isdigit():
        return int(datetime.strptime(text, "%Y%m%d").replace(tzinfo=timezone.utc).timestamp())
    when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp())


def _degrees(text: str | None, missing: int) -> int:
    return missing if text is None else int((Decimal(text) * 10_000_000).to_integral_value(ROUND_HALF_UP))


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read(f: BinaryIO) -> Iterator[dict]:
    """One dict per element. A missing position is that of the reader's default, -180 and -90 degrees."""
    change, root, depth = 0, None, 0
    for event, node in iterparse(f, ("start", "end")):
        if event == "start":
            root = node if root is None else root
            change = _CHANGE.get(node.tag, change)
            depth += 1
            continue
        depth -= 1
        if node.tag not in _KIND or depth > 2:
            if node.tag in _CHANGE:
                change = 0
                root.clear()
            continue
        a, kind = node.attrib, _KIND[node.tag]
        yield {
            "change": change, "kind": kind, "id": int(a["id"]), "version": _number(a.get("version")), "ts": parse_time(a.get("timestamp")),
            "changeset": _number(a.get("changeset")), "uid": _number(a.get("uid")), "user": a.get("user"), "visible": change != 1,
            "tags": [{"k": t.get("k"), "v": t.get("v")} for t in node.iterfind("tag")],
            "lon": _degrees(a.get("lon"), -1_800_000_000) if kind == 0 else None, "lat": _degrees(a.get("lat"), -900_000_000) if kind == 0 else None,
            "refs": [int(n.get("ref")) for n in node.iterfind("nd")] if kind == 1 else None,
            "members": [{"type": _KIND[m.get("type")], "ref": int(m.get("ref")), "role": m.get("role")} for m in node.iterfind("member") if m.get("type") in _KIND] if kind == 2 else None,
        }
        node.clear()
