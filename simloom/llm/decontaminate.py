"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are windows of `window` consecutive words of the benchmark items (a shorter item is one
pattern). For each pattern length m one searcher is built: a shift table over blocks of B words
tells how far the search may jump (m - B + 1 for a block in no pattern), the hash of a pattern's
last block leads to a bucket of patterns, and the words before it are compared directly. So a
document is mostly stepped over: in text that shares no block with a pattern one position in
m - B + 1 is looked at. Patterns of a bucket are told apart by their first block before words are
compared.

The benchmark is cut into blocks of items of bounded size, each broadcast on its own. A task builds
the searchers of one block once and reads its documents, so memory does not grow with the benchmark.
With one block, the usual case, documents are read once, in map tasks, without a shuffle. With more,
they are numbered and stored once and read once a block; what is found is joined by number, hits as
ranges of words, so that words that several blocks mark count once.

Nulls: a null text has no words and is clean; a null item text has no window; an item with a
null id marks words but is not listed. Repeated items count as one; repeated documents are rows
of their own, so there are no ties. Empty texts have no words; long texts are searched whole, and
a worker holds the words of SLICE texts or SLICE_BYTES of text, of one text at least. An empty
benchmark marks nothing, an empty table of documents gives an empty result. Columns that are not
asked for are not looked at, whatever their names. Words are kept as UTF-8 bytes: all bytes from
0x80 belong to words, so the byte pattern and the character pattern agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
_RUN = re.compile(rb"\x01+")
#: Bytes of benchmark text whose patterns are held and broadcast at once.
BLOCK_BYTES = 1 << 20
#: Texts and bytes of text whose words a worker holds at once.
SLICE = 500
SLICE_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Searcher:
    """Wu-Manber for patterns of one length over word sequences."""

    def __init__(self, patterns: dict[tuple, dict], length: int):
        self.m, self.b = length, min(2, length)
        self.far = length - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, owners in patterns.items():
            for end in range(self.b, length + 1):
                block = pattern[end - self.b : end] if self.b > 1 else pattern[end - 1]
                if length - end < self.shift.get(block, self.far):
                    self.shift[block] = length - end
            last = pattern[-self.b :] if self.b > 1 else pattern[-1]
            head = pattern[: self.b] if self.b > 1 else pattern[0]
            self.buckets.setdefault(last, {}).setdefault(head, []).append((pattern, owners))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, dict]]:
        """(start, owners) of each occurrence."""
        m, shift, far, n = self.m, self.shift, self.far, len(words)
        end, two = m, self.b > 1
        while end <= n:
            block = (words[end - 2], words[end - 1]) if two else words[end - 1]
            step = shift.get(block, far)
            if step:
                end += step
                continue
            start = end - m
            head = (words[start], words[start + 1]) if two else words[start]
            if head in self.buckets[block]:
                here = tuple(words[start:end])
                for pattern, owners in self.buckets[block][head]:
                    if pattern == here:
                        yield start, owners
            end += 1


def build(items: Iterable[tuple], window: int = WINDOW) -> list[Searcher]:
    """Searchers, one a pattern length, from (item id, text)."""
    by_length: dict[int, dict[tuple, dict]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            owners = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), {})
            if item is not None:
                owners[str(item)] = None
    return [Searcher(p, m) for m, p in sorted(by_length.items())]


def mark(words: list[bytes], searchers: Iterable[Searcher], hit: bytearray, found: set) -> None:
    """Set hit for words inside occurrences and add the items' ids to found."""
    for s in searchers:
        ones = b"\x01" * s.m
        for start, owners in s.search(words):
            hit[start : start + s.m] = ones
            found.update(owners)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of about block_bytes; the driver holds one partition and one block at a time."""
    block, held, full = [], 0, False
    for item, text in benchmark.toLocalIterator():
        block.append((item, text))
        held += len(text or "")
        if held >= block_bytes:
            yield block
            block, held = [], 0
            full = True
    if block or not full:
        yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Columns: id, n_words, n_hit, n_items, items (sorted ids, comma-joined), and those in keep.

    n_hit counts the words inside any occurrence of a pattern, n_items the items found.
    """
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id_col), F.col(item_text_col)).filter(F.col(item_text_col).isNotNull())
    blocks = [context.broadcast(block) for block in _blocks(items, block_bytes)]
    own = [F.col(c).alias(f"k{i}_") for i, c in enumerate(keep)]
    rows = docs.select(F.col(text_col).alias("text_"), F.col(id_col).alias("id_"), *own)
    if len(blocks) > 1:
        rows = materialise(rows.withColumn("row_", F.monotonically_increasing_id()), "numbered")
    found = _search(rows, blocks[0], window)
    if len(blocks) > 1:
        found = _merged(found, [_search(rows.select("text_", "row_"), block, window, hits_only=True) for block in blocks[1:]])
    else:
        covered = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
        found = found.withColumn("n_hit", covered)
    counts = ("n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))
    return found.select(F.col("id_").alias(id_col), *counts, *(F.col(f"k{i}_").alias(c) for i, c in enumerate(keep)))


def _search(rows: DataFrame, block: Broadcast, window: int, hits_only: bool = False) -> DataFrame:
    """rows without their first column, the text, with n_words, hits (ranges of words, apart and in order) and items (sorted).

    With hits_only rows without hits are left out.
    """
    names = rows.columns[1:]
    hits = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names), "n_words long, hits array<struct<start:long, end:long>>, items array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = build(block.value, window)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
            start = 0
            while start < batch.num_rows:
                stop = start + 1
                held = sizes[start]
                while stop < min(batch.num_rows, start + SLICE) and held + sizes[stop] <= SLICE_BYTES:
                    held += sizes[stop]
                    stop += 1
                at, n_words, ranges, items = [], [], [], []
                for i, text in enumerate(batch.column(0).slice(start, stop - start).to_pylist()):
                    words = words_of(text)
                    hit, found = bytearray(len(words)), set()
                    if words:
                        mark(words, searchers, hit, found)
                    if not hits_only or 1 in hit:
                        at.append(start + i)
                        n_words.append(len(words))
                        ranges.append([{"start": m.start(), "end": m.end()} for m in _RUN.finditer(hit)])
                        items.append(sorted(found))
                part = batch.take(pa.array(at, pa.int64()))
                made = [pa.array(n_words, pa.int64()), pa.array(ranges, hits), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(1 + i) for i in range(len(names))), *made], [*names, "n_words", "hits", "items"])
                start = stop

    return rows.mapInArrow(run, schema)


def _merged(found: DataFrame, others: list[DataFrame]) -> DataFrame:
    """found of the first block with what the other blocks found, and n_hit, the words in any range."""
    more = reduce(DataFrame.unionByName, others).groupBy("row_").agg(F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"))
    more = materialise(more, "more-hits")
    both = found.join(bounded(more), "row_", "left")
    hits = F.array_sort(F.concat("hits", F.coalesce("more_hits", F.array().cast(found.schema["hits"].dataType))))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, hit: Column) -> Column:
        new = F.greatest(F.lit(0).cast("long"), hit["end"] - F.greatest(hit["start"], state["end"]))
        return F.struct(F.greatest(state["end"], hit["end"]).alias("end"), (state["n"] + new).alias("n"))

    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))))
    return both.withColumn("n_hit", F.aggregate(hits, start, step, lambda s: s["n"])).withColumn("items", items).drop("hits", "more_hits", "more_items", "row_")


def contaminated(percent: int = 5):
    """Condition over the columns of `contamination`: at least percent of a document's words are hit."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))

