"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are normalised to words and cut into windows of ten consecutive words (a shorter item
is one window). All windows go into one automaton over normalised text, and every document is scanned
once; hits are mapped back to word numbers and to code points of the original text.

A benchmark is small beside a corpus, but nothing says how small: its windows are counted first and
dealt to as many automata as the bound ``max_windows`` asks for, one scan of the documents for each,
so that no task ever holds more. One automaton is the usual case.

Defined results: a null text has no words, in documents and items; an item without words has no window;
an item id that occurs on several rows is one item with the windows of all of them; repeated documents
give a row each; an empty benchmark hits nothing; a null item id is named by the empty string; columns
added here replace columns of the same name, all others are carried along.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.text import slices
from aerolake.llm.tables import without
from aerolake.session import cut

WINDOW = 10
#: Windows in one automaton; about 250 bytes each, so at most some 250 MB in a task.
MAX_WINDOWS = 1_000_000

#: Lower-cases A-Z and turns every separator of the word rule into a space, byte by byte.
_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def item_windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    words = normal_words(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def window_table(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window binary, item string) of all items, without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, item) for item, text in zip(*(batch.column(i).to_pylist() for i in range(2))) for w in item_windows(text, size)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([i for _, i in found], pa.string())], names=["window", "item"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    return rows.mapInArrow(run, "window binary, item string").distinct()


def automaton(windows: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    """Keys are windows between spaces, so that a hit begins and ends at word borders."""
    made = ahocorasick.Automaton()
    for window, items in windows:
        made.add_word(f" {window.decode('latin-1')} ", (len(window) + 1, window.count(b" ") + 1, tuple(items)))
    if len(made):
        made.make_automaton()
    return made


def scan(made: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int, tuple[str, ...]]]]:
    """(number of words, hits as (first word, end word, items)) of one text, read once from left to right."""
    words = normal_words(text)
    if not words or not len(made):
        return len(words), []
    line = b"".join((b" ", b" ".join(words), b" ")).decode("latin-1")
    raw = list(made.iter(line))
    if not raw:
        return len(words), []
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    return len(words), [(first := int(np.searchsorted(starts, end - length)), first + count, items) for end, (length, count, items) in raw]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code point spans of the text as it was given."""
    data = text.encode()
    edges = [m.span() for m in _WORD.finditer(data)]
    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    at = lambda byte: int(points[byte - 1]) if byte else 0
    return [(at(edges[a][0]), at(edges[b - 1][1])) for a, b in spans]


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>, chars array<struct<start:int,end:int>>"


def _pairs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def _scan_batches(made, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = pickle.loads(made.value)
        for batch in batches:
            for part in slices(batch, text):
                n_words, n_hit, items, spans, chars = [], [], [], [], []
                for value in part.column(part.schema.get_field_index(text)).to_pylist():
                    count, hits = scan(automata, value)
                    covered = merged([h[:2] for h in hits])
                    n_words.append(count)
                    n_hit.append(sum(b - a for a, b in covered))
                    items.append(sorted({i for h in hits for i in h[2]}))
                    spans.append(_pairs(covered))
                    chars.append(_pairs(original_offsets(value, covered)) if covered else [])
                columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN), pa.array(chars, _SPAN)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(f"d_{n}" for n in ("n_words", "n_hit", "items", "spans", "chars"))])

    return run


def _automata(benchmark: DataFrame, size: int, max_windows: int) -> list:
    """Broadcasts of automata with at most about ``max_windows`` windows each."""
    spark = benchmark.sparkSession
    table = cut(window_table(benchmark, size).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")))
    total = table.count()
    shards = max(1, -(-total // max_windows))
    made = []
    for k in range(shards):
        rows = table.filter(F.pmod(F.xxhash64("window"), F.lit(shards)) == k).collect()
        made.append(spark.sparkContext.broadcast(pickle.dumps(automaton([(bytes(r.window), list(r["items"])) for r in rows]))))
    return made


def scan_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents with ``d_n_words``, ``d_n_hit``, ``d_items``, ``d_spans`` (words) and ``d_chars`` (code points).

    With several automata the documents pass through them one after the other, and each adds its hits
    to the columns: still a narrow plan without a shuffle.
    """
    docs = without(docs, [f"d_{n}" for n in ("n_words", "n_hit", "items", "spans", "chars")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    made = ", ".join(f"d_{part.strip()}" for part in re.split(r", (?=\w+ )", RESULT))
    out = None
    for one in _automata(benchmark, size, max_windows):
        if out is None:
            out = docs.mapInArrow(_scan_batches(one, text), f"{fields}, {made}")
        else:
            out = out.mapInArrow(_add_batches(one, text), f"{fields}, {made}")
    return out


def _add_batches(made, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = pickle.loads(made.value)
        for batch in batches:
            for part in slices(batch, text):
                rows = {n: part.column(part.schema.get_field_index(n)).to_pylist() for n in ("d_n_hit", "d_items", "d_spans", "d_chars")}
                for i, value in enumerate(part.column(part.schema.get_field_index(text)).to_pylist()):
                    hits = scan(automata, value)[1]
                    if hits:
                        covered = merged([(s["start"], s["end"]) for s in rows["d_spans"][i]] + [h[:2] for h in hits])
                        rows["d_n_hit"][i] = sum(b - a for a, b in covered)
                        rows["d_items"][i] = sorted({*rows["d_items"][i], *(x for h in hits for x in h[2])})
                        rows["d_spans"][i], rows["d_chars"][i] = _pairs(covered), _pairs(original_offsets(value, covered))
                kinds = {"d_n_hit": pa.int64(), "d_items": pa.list_(pa.string()), "d_spans": _SPAN, "d_chars": _SPAN}
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[n]) if n in rows else part.column(i) for i, n in enumerate(part.schema.names)], names=part.schema.names)

    return run
