"""Passages of held-out test items that stand in training documents.

Texts are compared as streams of letters and digits: markup gone, macros and accents resolved, case folded, everything
else left out, so that spacing, punctuation and line breaks, even within a word, do not matter. Of a stream's k-gram
hashes the least one of each window of w is kept (winnowing): whatever two texts share over k + w - 1 characters, they
share a kept hash. Documents' kept hashes are joined with the items'; each hit is extended to both sides and counts
if it covers enough whole words of the item. Before the join, hashes that no item has are dropped by a filter of fixed
size, so of a large corpus only the documents that may hold something go on, with their streams.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm import tex
from mapweave.session import fresh_path, written

MIN_WORDS, MIN_CHARS = 12, 24
_SHARE = 1000  # items that one row of the last step may name
FILTER_BITS = 26  # the filter of the items' hashes has 2**26 bits, 8 MB, however many items there are

_NOISE = re.compile(
    r"\\(?:[A-Za-z]*cite[A-Za-z]*|[A-Za-z]*ref|label|url|bibitem|input|include|includegraphics|vspace|hspace)\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}"
    r"|\\(?:begin|end)\s*\{[^{}]*\}(?:\[[^\]]*\])?|\\[A-Za-z@]+\*?|\\[^A-Za-z]"
)
_DROP = re.compile(r"[\W_]+")
_HAN = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[\u0300-\u036f]")


def _fold(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).lower())


def letter_stream(text: str) -> str:
    """Letters and digits of a TeX text, comments included, as compared."""
    if "\\" in text:
        text = tex.resolve_accents(tex.expand(text, tex.definitions(text)))
        text = _NOISE.sub(" ", text)
    return _DROP.sub("", _fold(text))


_MID_COMMENT = re.compile(r"(?<=[^\s\\%])([ \t]*)(?<!\\)%[^\n]*(?:\n[ \t]*|$)")


def streams(text: str) -> list[str]:
    """The streams of a document: as it stands, and, where a comment follows text on its line, once more without such."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    own = [letter_stream(text)]
    if "%" in text:
        without = _MID_COMMENT.sub(" ", text)
        if without != text:
            own.append(letter_stream(without))
    return own


class Item(NamedTuple):
    item_id: int
    stream: str
    starts: list[int]  # where the item's units (words, or characters) start in the stream
    ends: list[int]
    need: int  # units in a row that count as a leak


def item_units(item_id: int, text: str) -> Item:
    """An item as compared. Mostly Chinese text is counted in characters and digits, other text in words."""
    folded = _fold(tex.resolve_accents(text))
    words = _WORD.findall(folded)
    stream = "".join(words)
    if len(_HAN.findall(stream)) * 2 > len(stream):
        at = list(range(len(stream) + 1))
        return Item(item_id, stream, at[:-1], at[1:], MIN_CHARS)
    ends = np.cumsum([len(w) for w in words]).tolist()
    return Item(item_id, stream, [0, *ends[:-1]], ends, MIN_WORDS)


def covered(item: Item, start: int, end: int) -> int:
    """Whole units of the item within [start, end) of its stream."""
    return max(0, bisect_left(item.ends, end + 1) - bisect_left(item.starts, start))


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k characters in a row: differences of prefix sums of code times base**place, moved to place 0."""
    terms = (codes + np.uint64(1)) * _powers(_BASE, len(codes))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return _spread((prefix[k:] - prefix[:-k]) * _powers(pow(_BASE, -1, 2**64), len(codes) - k + 1))


def _window_least(h: np.ndarray, w: int) -> np.ndarray:
    least, size = h, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(h) - w + 1], least[w - size : w - size + len(h) - w + 1])


def kept_hashes(stream: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that winnowing keeps: the least of every w in a row, all of equals.

    A stream of fewer than k + w - 1 characters keeps the least of what it has, one of fewer than k nothing.
    """
    codes = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(codes, k)
    least = _window_least(h, min(w, n))
    # Kept is what is the least of one of the windows over it, that is: what equals the greatest of their leasts.
    edge = np.zeros(min(w, n) - 1, np.uint64)
    most = ~_window_least(~np.concatenate([edge, least, edge]), min(w, n))
    at = np.flatnonzero(most == h)
    return at, h[at]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def leaks(item: Item, texts: list[np.ndarray], lines: list[tuple[int, int]]) -> bool:
    """Whether along one of the diagonals (which text, place in it less place in the item) enough units stand in a row.

    Along a diagonal hits are extended to both sides all at once: these are the runs of characters that agree.
    """
    own = _codes(item.stream)
    for side, shift in lines:
        other = texts[side]
        low, high = max(0, -shift), min(len(own), len(other) - shift)
        same = np.zeros(max(0, high - low) + 2, np.int8)
        same[1:-1] = own[low:high] == other[low + shift : high + shift]
        edge = np.flatnonzero(np.diff(same)) + low
        if any(covered(item, a, b) >= item.need for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())):
            return True
    return False


def window_sizes(shortest: int, k: int = 14) -> tuple[int, int]:
    """k and w such that k + w - 1 is the fewest characters that a leak can have."""
    k = min(k, max(1, shortest - 1))
    return k, max(1, shortest - k + 1)


def shortest_leak(items: list[Item]) -> int:
    return min((it.ends[i + it.need - 1] - it.starts[i] for it in items for i in range(len(it.ends) - it.need + 1)), default=MIN_CHARS)


def _least_shared(item: Item, k: int, w: int) -> int:
    runs = (item.stream[item.starts[i] : item.ends[i + item.need - 1]] for i in range(len(item.ends) - item.need + 1))
    return max(1, min((len(kept_hashes(run, k, w)[0]) for run in runs), default=1))


def _prints(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    """``item, h, at, need`` of all kept hashes of the items: need is how many of them any leak of the item shares.

    What winnowing keeps of a run by itself it keeps in every text that holds the run, at the same places of it, so all
    of that is shared, and lies on one diagonal; the run of the item with the fewest of them counts.
    """
    for b in batches:
        parsed = [item_units(0, t) for t in b.column("item_text").to_pylist()]
        kept = [kept_hashes(it.stream, k, w) for it in parsed]
        n = [len(h) for _, h in kept]
        need = np.repeat([_least_shared(it, k, w) for it in parsed], n).astype(np.int64)
        at, hashes = (np.concatenate([np.zeros(0, np.int64), *[x[i].view(np.int64) for x in kept]]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(hashes), pa.array(at), pa.array(need)], names=["item", "h", "at", "need"])


def _places(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The bits of the filter that stand for each hash: three numbers of ``size`` bits out of it."""
    h = h.view(np.uint64)
    return [(h << np.uint64(left) >> np.uint64(64 - size)).astype(np.int64) for left in (0, 19, 38)]


def _item_filter(prints: DataFrame, size: int) -> np.ndarray:
    """The bits of all hashes of ``h``, put together by the engine's own bitmaps; at most 2**size of them."""
    per = 1 << 15

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(b.column("h").to_numpy(), size)))], names=["at"])

    rows = prints.select("h").mapInArrow(places, "at bigint").select(F.shiftright("at", 15).alias("part"), F.pmod("at", F.lit(per)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << size - 3, np.uint8)
    for r in rows:
        out[r["part"] * (per // 8) : (r["part"] + 1) * (per // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places in ``hashes`` of those that the filter lets through."""
    left = np.arange(len(hashes))
    for place in _places(hashes, len(bits).bit_length() + 2):
        place = place[left]
        left = left[bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1]
    return left


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, item_id`` of each document that holds a leaked run of an item, anywhere, comments included; distinct.

    A run is ``MIN_WORDS`` successive words of the item, or ``MIN_CHARS`` successive characters and digits where the
    item is mostly Chinese. Items with fewer units cannot leak; null and empty texts hold nothing; rows without an id
    are left out; of an id that stands on several rows, document or item, each text counts. Whole texts are read,
    whatever their length. Empty tables give an empty result.

    Documents are read and fingerprinted once, without a shuffle. Those with a hash that passes the items' filter go on,
    with such hashes and their streams, into a table in the shared folder; of foreign hashes the filter lets through about
    the cube of the share of its bits that the items' hashes take. The hashes are joined with the items'; pairs of a document and an item that
    have as many of them on one diagonal as any leak has are verified, each once, beside the document's streams.
    """
    spark = docs.sparkSession
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).distinct()
    item_path = fresh_path(spark, "items")
    wanted = written(wanted.withColumn("item", F.monotonically_increasing_id()), "items", item_path)

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shortest_leak([item_units(0, t)]) for t in b.column("item_text").to_pylist()], pa.int64())], names=["n"])

    # The fewest characters that a leak of any item can have sets the windows of all.
    k, w = window_sizes(wanted.mapInArrow(shortest, "n bigint").agg(F.min("n")).first()[0] or MIN_CHARS)
    prints = written(wanted.select("item", "item_text").mapInArrow(lambda batches: _prints(batches, k, w), "item bigint, h bigint, at bigint, need bigint"), "prints")
    known = spark.sparkContext.broadcast(_item_filter(prints, filter_bits))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = streams(body) if body else []
                hits = []
                for at, h in (kept_hashes(s, k, w) for s in own):
                    left = _passing(h, bits)
                    hits.append((h[left].view(np.int64), at[left]))
                if any(len(h) for h, _ in hits):
                    side = np.repeat(np.arange(len(hits)), [len(h) for h, _ in hits])
                    for a, v in zip(out, (doc, *map(np.concatenate, zip(*hits)), side, own)):
                        a.append(v)
            kinds = (pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["doc_id", "h", "place", "side", "streams"])

    bodies = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    met = bodies.mapInArrow(meet, "doc_id bigint, h array<bigint>, place array<bigint>, side array<bigint>, streams array<string>")
    met = written(met.withColumn("doc", F.monotonically_increasing_id()), "met")
    hits = met.select("doc", F.explode(F.arrays_zip("h", "place", "side")).alias("z")).select("doc", "z.*").join(prints, "h")
    shift = (F.col("place") - F.col("at")).alias("shift")
    lines = hits.groupBy("doc", "item", "side", shift).agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need")
    # A document goes on once, beside the diagonals of up to ``_SHARE`` items, and not once with each item.
    share = F.floor(F.col("item") / _SHARE).alias("share")
    groups = lines.groupBy("doc", share).agg(F.collect_list(F.struct("item", "side", "shift")).alias("lines"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[], []]
            for doc, own, lines in zip(*[b.column(c).to_pylist() for c in ("doc_id", "streams", "lines")]):
                by_item: dict[int, list[tuple[int, int]]] = {}
                for x in lines:
                    by_item.setdefault(x["item"], []).append((x["side"], x["shift"]))
                codes = [_codes(s) for s in own]
                items = _items(item_path, min(by_item) // _SHARE)
                found = {items[i].item_id for i, at in by_item.items() if leaks(items[i], codes, at)}
                out[0] += [doc] * len(found)
                out[1] += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "item_id"])

    beside = groups.join(met.select("doc", "doc_id", "streams"), "doc").select("doc_id", "streams", "lines")
    return beside.mapInArrow(verify, "doc_id bigint, item_id bigint").distinct()


@lru_cache(maxsize=64)
def _items(path: str, share: int) -> dict[int, Item]:
    """The items of one share by their numbers, out of the table in the shared folder."""
    where, inner = fs.FileSystem.from_uri(path)
    at = ds.field("item")
    rows = ds.dataset(inner, filesystem=where, format="parquet").to_table(filter=(at >= share * _SHARE) & (at < (share + 1) * _SHARE))
    return {r["item"]: item_units(r["item_id"], r["item_text"]) for r in rows.to_pylist()}
