"""Mixing sources to target shares of the total size in tokens.

Documents are counted by exact token length; a source's budget is filled with whole rounds of all its documents and,
for the rest, documents drawn in seeded order, until what is left is small; bounded-knapsack dynamic programming over
the length counts then finds the lengths that come nearest to it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.session import written

_CACHE = 400_000  # chunks a task remembers the token count of


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file: a line for each, the token in base 64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks_of(vocabulary), special_tokens={})


# A blank run and what follows it up to the next blank. The tokenizer's pattern never joins a non-blank to a blank
# after it, so a text's tokens are those of its chunks.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_BLANK}]*[^{_BLANK}]+")
_TAIL = re.compile(f"[{_BLANK}]+\\Z")


class _Counts(dict):
    def __init__(self, vocabulary: bytes, pattern: str):
        super().__init__()
        self.encoder = _encoder(vocabulary, pattern)

    def __missing__(self, chunk: str) -> int:
        n = len(self.encoder.encode_ordinary(chunk))
        if len(self) >= _CACHE:
            self.clear()
        self[chunk] = n
        return n


@lru_cache(maxsize=2)
def token_counter(vocabulary: bytes, pattern: str) -> Callable[[str], int]:
    """Counts the tokens of a text, specials read as ordinary text."""
    count = _Counts(vocabulary, pattern)

    def tokens(text: str) -> int:
        total = sum(map(count.__getitem__, _CHUNK.findall(text)))
        tail = _TAIL.search(text, max(0, len(text) - 1)) and _TAIL.search(text)
        return total + (count[tail.group()] if tail else 0)

    return tokens


def with_token_counts(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """``doc_id, source, n_tokens``; ``docs`` needs ``doc_id, text, source``. A null text has no tokens.

    The vocabulary, a file of about a megabyte, goes out with the job, so workers need no file of their own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(sent.value, pattern)
        for b in batches:
            n = [count(t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def fit_lengths(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum comes as near to ``budget`` from below as possible.

    Bounded knapsack over the reachable sums, as bits of one integer; counts are split into powers of two.
    """
    items: list[tuple[int, int]] = []
    for length, n in sorted(lengths.items()):
        n, k = min(n, budget // length if length else 0), 1
        while n > 0:
            items.append((length, min(k, n)))
            n -= k
            k *= 2
    mask, reach = (1 << (budget + 1)) - 1, [1]
    for length, k in items:
        reach.append((reach[-1] | reach[-1] << length * k) & mask)
        if reach[-1] >> budget & 1:
            break
    rest, taken = reach[-1].bit_length() - 1, {}
    for (length, k), before in zip(reversed(items[: len(reach) - 1]), reversed(reach[:-1])):
        if not before >> rest & 1:
            rest -= length * k
            taken[length] = taken.get(length, 0) + k
    return taken


def plan_budgets(have: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, int]:
    """Tokens to draw per source: the largest total at which every source with documents can give its share.

    Sources without documents cannot give theirs; the shares of the others keep their ratios.
    """
    usable = [(s, share, have[s] * cap) for s, share, cap in targets if have.get(s, 0) > 0 and share > 0 and cap > 0]
    whole = sum(share for _, share, _ in usable)
    total = min((most * whole / share for _, share, most in usable), default=0)
    return {s: min(most, int(total * share / whole)) for s, share, most in usable}


def mix_sources(docs: DataFrame, targets: DataFrame, vocabulary: bytes, pattern: str, seed: int = 7, window: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Draw documents so that each source makes up its share of the total size. Returns (draws, report).

    ``docs``: ``doc_id, text, source``; ``targets``: ``source_name, target_share, max_repeats``. Draws: ``doc_id,
    source, n_tokens, copies`` of every document used; ``copies`` is never above ``max_repeats``. Report, one row for
    each source on either side: ``source, target_share, actual_share, n_docs_used, n_tokens_used, max_copies``. Shares
    and caps that are null or not above 0 draw nothing; a repeated target counts once, with its largest share.
    ``vocabulary`` and ``pattern`` are those of a byte-level tokenizer. Documents without a source or tokens are never
    drawn. Without documents or targets no draws come out.

    The total is the largest at which every target source that has documents can still give its share. Each source
    first gives all its documents as many times as they fit. For what then remains of its budget, documents come in
    an order seeded by their id, until less than ``window`` tokens are missing; the lengths that fill those are found by
    dynamic programming over the exact length counts of the documents that follow, and filled in the same order. What
    reaches the driver, and goes out again by broadcast, are the token sums per source and hash range, of which there
    are 4,096, and the length counts within twice the window: bounded by the number of target sources, never documents.
    """
    spark = docs.sparkSession
    sized = written(with_token_counts(docs, vocabulary, pattern), "sizes").where("source is not null and n_tokens > 0")
    want = targets.where("source_name is not null").groupBy("source_name").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source_name", "t.*")
    goals = [(r["source_name"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in want.collect()]
    named = sized.join(F.broadcast(want.select(F.col("source_name").alias("source"))), "source", "left_semi")
    have = {r["source"]: r["n"] for r in named.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    budget = plan_budgets(have, goals)
    plan = {s: (b // have[s], b - b // have[s] * have[s]) for s, b in budget.items()}
    rounds = spark.createDataFrame([(s, int(full), int(rest)) for s, (full, rest) in plan.items()], "source string, full bigint, rest bigint")

    # The running sum in seeded order goes over hash ranges, so no source lies in one task.
    n_parts = 4096
    h = F.xxhash64(F.lit(seed), "doc_id")
    order = sized.join(F.broadcast(rounds), "source").withColumn("h", h).withColumn("part", F.pmod(F.shiftright("h", 40), F.lit(n_parts)))
    sums = order.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    parts: dict[str, list[tuple[int, int]]] = {}
    for r in sums.collect():
        parts.setdefault(r["source"], []).append((r["part"], r["n"]))
    # Whole parts are taken while they fit; the part at which they no longer do, and those after it up to twice the
    # window, are where the last documents come from.
    bounds = []
    for s, (full, rest) in plan.items():
        run, first, last = 0, n_parts, n_parts
        for part, n in sorted(parts.get(s, [])):
            if first == n_parts and run + n > rest:
                first, base = part, run
            run += n
            if first != n_parts and run >= rest + window:
                last = part
                break
        bounds.append((s, first, last, rest - (base if first != n_parts else min(rest, run))))
    edge = spark.createDataFrame(bounds, "source string, first bigint, last bigint, missing bigint")
    order = order.join(F.broadcast(edge), "source")
    lengths: dict[str, dict[int, int]] = {}
    near = order.where((F.col("part") >= F.col("first")) & (F.col("part") <= F.col("last")) & (F.col("missing") > 0))
    for r in near.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        lengths.setdefault(r["source"], {})[r["n_tokens"]] = r["n"]
    missing = {s: m for s, _, _, m in bounds}
    takes = []
    for s, by_length in lengths.items():
        left, base = missing[s], {}
        # Down to the window, lengths are taken in proportion, so that the table of reachable sums stays small.
        size = sum(k * n for k, n in by_length.items())
        if left > window:
            base = {k: int(n * (left - window) / size) for k, n in by_length.items()}
            left -= sum(k * n for k, n in base.items())
        fit = fit_lengths({k: n - base.get(k, 0) for k, n in by_length.items()}, left)
        takes += [(s, int(k), int(base.get(k, 0) + fit.get(k, 0))) for k in by_length if base.get(k, 0) + fit.get(k, 0)]
    take = spark.createDataFrame(takes, "source string, n_tokens bigint, take bigint")
    ranked = near.withColumn("nth", F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("h", "doc_id")))
    drawn = ranked.join(F.broadcast(take), ["source", "n_tokens"]).where(F.col("nth") <= F.col("take")).select("doc_id", "source", "n_tokens", F.lit(1).cast("bigint").alias("more"))
    taken = order.where(F.col("part") < F.col("first")).select("doc_id", "source", "n_tokens", F.when(F.col("rest") > 0, 1).otherwise(0).cast("bigint").alias("more"))
    base = order.where("full > 0").select("doc_id", "source", "n_tokens", F.col("full").alias("more"))
    draws = base.unionByName(taken).unionByName(drawn).groupBy("doc_id", "source", "n_tokens").agg(F.sum("more").alias("copies")).where("copies > 0")
    draws = written(draws, "draws")

    used = draws.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens_used"), F.max("copies").alias("max_copies"))
    every = sized.select("source").distinct().unionByName(want.select(F.col("source_name").alias("source"))).distinct()
    total = draws.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
    report = every.join(want.select(F.col("source_name").alias("source"), "target_share"), "source", "left").join(used, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    share = F.lit(0.0) if not total else F.coalesce(F.col("n_tokens_used"), F.lit(0)) / F.lit(float(total))
    return draws, report.select("source", "target_share", share.alias("actual_share"), zero("n_docs_used"), zero("n_tokens_used"), zero("max_copies"))
