"""Operator 5: benchmark decontamination by one Aho-Corasick automaton.

A text's words are the runs outside ASCII punctuation, blanks and controls, with
A-Z lower-cased.  The windows of all benchmark items (``window`` consecutive
words; an item with fewer is one window) form one automaton over numbers of words;
each document's words are numbered, those that no item has as 0, and its stretches
without 0 are scanned once.  A word inside any occurrence of a window is hit; hits
map back to code-point offsets of the original text, as lower-casing ASCII letters
keeps every offset.

The benchmark is read in chunks of at most ``chunk_chars`` characters, a word
counting as ``WORD_CHARS`` at least, and longer items in overlapping pieces with the
same windows.  So an automaton has at most ``chunk_chars / WORD_CHARS * window``
nodes of some 45 bytes: 225 MB at the defaults, whatever the benchmark's size.
Each further chunk is one more pass, one after the other, over a written table.

Defined results: a null or empty text has no words, no hits and is clean; an item
without words has no window; repeated items count by their ids once; repeated
documents give repeated rows; an empty benchmark makes everything clean; an empty
document table gives no rows; further columns are ignored.  Item ids may be of
any type, are compared as strings; a null item id is read as the string ``null``.
Texts are scanned whole, however long.  A window of several items belongs to all
of them.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import cache, cut, discard, python_ready, table, text_of, worker_task

WINDOW = 10
CHUNK_CHARS = 4_000_000
WORD_CHARS = 8
#: The word pattern, and what lies between words.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lowered(text or ""))


_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    return text.translate(_LOWER)


def windows_of(words, window: int = WINDOW) -> list[tuple]:
    if not words:
        return []
    if len(words) <= window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class Windows:
    """The automaton over all windows of the items.

    ``vocabulary`` holds the items' words, numbered from 1 in their order; a
    pattern's value is (its number of words, its items)."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        numbers: dict[str, int] = {}
        self.shortest = window
        alone: dict[tuple, tuple] = {}  # one object for the windows of one item only
        for item, text in items:
            words = tuple(numbers.setdefault(w, len(numbers) + 1) for w in text.split(" "))
            for w in windows_of(words, window):
                old = self.machine.get(w, None)
                own = alone.setdefault((len(w), item), (len(w), (item,)))
                if old is None:
                    self.machine.add_word(w, own)
                    self.shortest = min(self.shortest, len(w))
                elif item not in old[1]:
                    self.machine.add_word(w, (old[0], tuple(sorted((*old[1], item)))))
        self.vocabulary = pa.array(list(numbers), pa.string())
        if numbers:
            self.machine.make_automaton()

    def nodes(self) -> int:
        return self.machine.get_stats()["nodes_count"]

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of a batch, and where each text's begin."""
        lists = pc.ascii_split_whitespace(pc.utf8_trim(normalised(texts), " "))
        flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # of a text without words
        if blank.any():
            flat = flat.filter(pa.array(~blank))
            ends = ends - np.concatenate([[0], np.cumsum(blank)])[ends - ends[0]]
        coded = flat.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return (known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(len(flat), np.int64)), ends - ends[0]

    def found(self, numbers: np.ndarray):
        """(first word, past the last, items) of every occurrence in a text."""
        if not len(self.vocabulary):
            return
        bounds = np.flatnonzero(np.diff(np.concatenate([[0], numbers > 0, [0]])))
        for a, b in bounds.reshape(-1, 2):
            if b - a >= self.shortest:
                for last, (n, who) in self.machine.iter(tuple(numbers[a:b].tolist())):
                    yield int(a) + last + 1 - n, int(a) + last + 1, who


def _cached(key: str, items, window: int) -> Windows:
    machines = cache("automata")
    if key not in machines:
        machines.clear()
        machines[key] = Windows(items, window)
    return machines[key]


def covered(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of word intervals in the original text."""
    at = [(m.start(), m.end()) for m in WORD.finditer(lowered(text))]
    return [(at[a][0], at[b - 1][1]) for a, b in intervals]


def normalised(texts: pa.Array) -> pa.Array:
    """``" w1 w2 ... wn "`` for each text, two blanks for one without words."""
    normal = pc.replace_substring_regex(pc.ascii_lower(texts), BETWEEN, " ")
    return pc.binary_join_element_wise("", pc.utf8_trim(normal, " "), "", " ")


def benchmark_chunks(benchmark: DataFrame, item_column: str, text_column: str, chunk_chars: int, window: int):
    """Lists of (item, normalised words), one chunk on the driver at a time."""
    items = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("null")).alias("item"), text_of(text_column).alias("text"))
    chunk, size = [], 0
    for r in items.toLocalIterator():
        words = words_of(r.text)
        while words:
            piece, taken = [], 0
            for w in words:
                if taken >= chunk_chars and len(piece) >= window:
                    break
                piece.append(w)
                taken += max(len(w) + 1, WORD_CHARS)
            if chunk and size + taken > chunk_chars:
                yield chunk
                chunk, size = [], 0
            chunk.append((r.item, " ".join(piece)))
            size += taken
            # The next piece begins with the first window that this one does not hold.
            words = words[len(piece) - window + 1 :] if len(piece) < len(words) else []
    yield chunk


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: the id, ``n_words``, ``hits`` (merged word
    intervals), ``spans`` (the same in code points) and ``items`` (sorted ids of
    the items with occurring windows)."""
    spark = docs.sparkSession
    python_ready(spark)
    id_type = docs.schema[id_column].dataType.simpleString()
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["id", "text", "n_words", "hits", "spans", "items"]
    kind = "array<struct<start:bigint,end:bigint>>"
    schema = f"id {id_type}, text string, n_words bigint, hits {kind}, spans {kind}, items array<string>"
    no = [F.lit(None).cast(t).alias(n) for n, t in (("n_words", "bigint"), ("hits", kind), ("spans", kind), ("items", "array<string>"))]
    out = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"), *no)

    def scanner(items: list[tuple[str, str]], last: bool):
        shared = spark.sparkContext.broadcast(items)  # at most chunk_chars of text
        key = uuid.uuid4().hex

        def run(batches):
            machine = _cached(key, shared.value, window)
            for batch in batches:
                texts = batch.column("text")
                numbers, ends = machine.numbered(texts)
                hits, spans, who = [], [], []
                for i, (old, had) in enumerate(zip(batch.column("hits"), batch.column("items"), strict=True)):
                    found, items_hit = [], set()
                    for a, b, which in machine.found(numbers[ends[i] : ends[i + 1]]):
                        found.append((a, b))
                        items_hit.update(which)
                    if had.is_valid:
                        found += [(x["start"], x["end"]) for x in old.as_py()]
                        items_hit |= set(had.as_py())
                    found = covered(found)
                    hits.append([{"start": a, "end": b} for a, b in found])
                    at = char_spans(texts[i].as_py(), found) if found and last else []
                    spans.append([{"start": a, "end": b} for a, b in at])
                    who.append(sorted(items_hit))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), texts if not last else pa.nulls(len(texts), pa.string()), pa.array(np.diff(ends)),
                    pa.array(hits, pair), pa.array(spans, pair), pa.array(who, pa.list_(pa.string())),
                ], names=names)

        return run

    chunks, scratch = benchmark_chunks(benchmark, item_column, item_text, chunk_chars, window), []
    held = next(chunks)
    for following in chunks:
        done = list(scratch)
        out = cut(out.mapInArrow(worker_task(scanner(held, False), "automata"), schema), "scanned", scratch)
        scratch = scratch[len(done) :]
        discard(spark, done)
        held = following
    out = out.mapInArrow(worker_task(scanner(held, True), "automata"), schema)
    return out.select(F.col("id").alias(id_column), "n_words", "hits", "spans", "items")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
                    item_text: str = "text", window: int = WINDOW, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows without any benchmark window, whole."""
    spark = docs.sparkSession
    python_ready(spark)
    at = docs.columns.index(text_column)

    def filter_of(items: list[tuple[str, str]]):
        shared = spark.sparkContext.broadcast(items)  # at most chunk_chars of text
        key = uuid.uuid4().hex

        def run(batches):
            machine = _cached(key, shared.value, window)
            for batch in batches:
                numbers, ends = machine.numbered(pc.fill_null(batch.column(at), ""))
                clean = [next(machine.found(numbers[a:b]), None) is None for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    chunks, scratch = benchmark_chunks(benchmark, item_column, item_text, chunk_chars, window), []
    held = next(chunks)
    for following in chunks:
        done = list(scratch)
        docs = cut(docs.mapInArrow(worker_task(filter_of(held), "automata"), docs.schema), "clean", scratch)
        scratch = scratch[len(done) :]
        discard(spark, done)
        held = following
    return docs.mapInArrow(worker_task(filter_of(held), "automata"), docs.schema)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each whole document that benchmark windows cover."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr(
        "doc_id", "n_words", "aggregate(hits, 0L, (n, h) -> n + h.end - h.start) as n_hit",
        "cast(size(items) as bigint) as n_items", "sha2(array_join(items, ','), 256) as items_sha256",
        "size(hits) > 0 as contaminated",
    )


ORACLE_OP5 = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, len(v) AS n, array_to_string(v, ' ') AS k
  FROM (SELECT item, w[i : i + 9] AS v
        FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
occ AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT o.doc_id, o.i, o.n, x.item FROM occ o JOIN win x ON o.n = x.n AND o.k = x.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
ORACLE = {"op5_benchmark_decontamination": ORACLE_OP5}
