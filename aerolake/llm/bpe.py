"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts every text where the text itself says so, so that passages
shared by documents fall into the same chunks. A chunk is encoded once for all the documents of a
task, up to its outer pieces: the pieces at both ends may be parts of words that a cut went through.
Joins are repaired by encoding the pieces on both sides as one, together with ``k`` words of each
neighbour; if the neighbours' tokens come out as in their chunks, the join is exact, else ``k`` is
doubled, in the end up to the whole text.

Within a chunk, text between white space is encoded once and remembered. That is exact as long as the
tokenizer never joins across white space; every join repeats that test, and ``Encoder`` runs it at its
start. A tokenizer that fails it is used on whole texts.

The passes are narrow: nothing is shuffled, and a lost task only repeats itself. Memory is bounded by
``MAX_WORDS`` and ``MAX_CHUNK_BYTES`` in each Python worker; what falls out of a memory is encoded anew.

Defined results: a null text is encoded as an empty one (no tokens, empty decoded text); repeated rows
give a row each; an empty table gives an empty table; other columns are carried along.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aerolake.llm.text import _BYTES, Texts, _power_tables, mix, slices

#: The rolling hash sees this many bytes; a cut follows where its low bits are zero.
ROLL_BYTES = 24
CHUNK_BYTES = 1024
#: Remembered words and bytes of remembered chunks in a Python worker.
MAX_WORDS = 400_000
MAX_CHUNK_BYTES = 16_000_000
MAX_JOINS = 50_000
#: Unknown words that are encoded in one call.
LINE_WORDS = 1000

_BLANK = b" \t\n\r"
_PROBE = "It's a tést, N° 42!\n\tAnd the re-test <|endoftext|> of Étude's 3rd  line."


def cuts(data: np.ndarray, roll: int = ROLL_BYTES, average: int = CHUNK_BYTES) -> np.ndarray:
    """Places of the byte array after which a chunk ends; ``average`` is a power of two."""
    if len(data) <= roll:
        return np.zeros(0, np.int64)
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    rolled = mix((sums[roll:] - sums[:-roll]) * inverse[: len(data) - roll + 1])
    at = np.flatnonzero((rolled & np.uint64(average - 1)) == 0) + roll
    return at[(at < len(data)) & ((data[np.minimum(at, len(data) - 1)] & 0xC0) != 0x80)]


class Encoder:
    """A tokenizer with its memories. ``piece``: (number of tokens, ids as text, decoded text)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, tuple] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.agreed: dict[bytes, bool] = {}
        self.chunk_bytes = 0
        self.encoded_chunks = self.reused_chunks = self.widened = 0
        self.names = {i: t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.digits = {i: b"%d" % i for i in self.names}
        whole = self.ids(_PROBE)
        parts = [i for w in _PROBE.split() for i in self.ids(w)]
        self.splits = whole == parts and self.tokenizer.decode(whole, skip_special_tokens=False).encode() == self._piece(whole)[2]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, ids: list[int]) -> tuple:
        return len(ids), b" ".join([self.digits[i] for i in ids]), b" ".join([self.names[i] for i in ids])

    def whole(self, text: str) -> tuple:
        ids = self.ids(text)
        return len(ids), b" ".join([self.digits[i] for i in ids]), self.tokenizer.decode(ids, skip_special_tokens=False).encode()

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words that are not remembered: ``LINE_WORDS`` of them as one line, taken apart by offsets."""
        known = self.words
        new = [w for w in words if w not in known]
        if len(known) + len(new) > MAX_WORDS:
            known.clear()
            new = list(words)
        for low in range(0, len(new), LINE_WORDS):
            line = [w.decode() for w in new[low : low + LINE_WORDS]]
            got = self.tokenizer.encode(" ".join(line), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in line])
            begins = np.array([a for a, _ in got.offsets], np.int64)
            cuts_ = [0, *np.searchsorted(begins, ends).tolist()]
            ids = got.ids
            for word, a, b in zip(new[low : low + LINE_WORDS], cuts_, cuts_[1:]):
                known[word] = self._piece(ids[a:b])

    def joined(self, pieces: list[tuple]) -> tuple:
        full = [p for p in pieces if p[0]]
        return sum([p[0] for p in full]), b" ".join([p[1] for p in full]), b" ".join([p[2] for p in full])

    def word_pieces(self, words: list[bytes]) -> tuple:
        known = self.words
        return self.joined([known[w] for w in words])

    def inner(self, chunk: bytes, words: list[bytes]) -> tuple:
        """The chunk without its outer pieces."""
        found = self.chunks.get(chunk)
        if found is not None:
            self.reused_chunks += 1
            return found
        self.encoded_chunks += 1
        self.learn(set(words))  # a full memory may have been cleared since the text's words were learnt
        found = self.word_pieces(words)
        self.chunk_bytes += 2 * len(chunk) + len(found[1]) + len(found[2]) + 300
        if self.chunk_bytes > MAX_CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        self.chunks[chunk] = found
        return found

    def join(self, left: list[bytes], middle: bytes, right: list[bytes]) -> tuple | None:
        """The tokens of the piece at a join; None if no window of the text gives agreement."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            self.learn({middle, *a, *b})
            window = b" ".join([*a, middle, *b])
            if self.agreed.get(window) or self._piece(self.ids(window.decode()))[1] == self.joined([self.words[w] for w in (*a, middle, *b)])[1]:
                if len(self.agreed) > MAX_JOINS:
                    self.agreed.clear()
                self.agreed[window] = True
                return self.words[middle]
            if k > len(left) and k > len(right):
                return None
            self.widened += 1
            k *= 2


_PIECES = re.compile(rb"[^ \t\n\r]+")


def encode_text(encoder: Encoder, text: bytes, at: list[int]) -> tuple:
    """(number of tokens, ids as text, decoded text) of one text with its cuts."""
    if not encoder.splits:
        return encoder.whole(text.decode())
    chunks = [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]
    split = []
    for chunk in chunks:
        words = _PIECES.findall(chunk)
        head = bool(words) and chunk[:1] not in _BLANK_SET
        tail = bool(words) and chunk[-1:] not in _BLANK_SET
        split.append((words, head, tail))
    encoder.learn({w for words, head, tail in split for w in words[1 if head else 0 : len(words) - 1 if tail else len(words)]})
    out, before, open_piece = [], [], b""
    for chunk, (words, head, tail) in zip(chunks, split):
        if words and head and tail and len(words) == 1:  # no white space: the piece goes on
            open_piece += words[0]
            continue
        first = words[0] if head else b""
        body = words[1 if head else 0 : len(words) - 1 if tail else len(words)]
        piece = open_piece + first
        if piece:
            got = encoder.join(before, piece, body)
            if got is None:
                return encoder.whole(text.decode())
            out.append(got)
        out.append(encoder.inner(chunk, body))
        before = body or before
        open_piece = words[-1] if tail else b""
    if open_piece:
        got = encoder.join(before, open_piece, [])
        if got is None:
            return encoder.whole(text.decode())
        out.append(got)
    return encoder.joined(out)


_BLANK_SET = {bytes([b]) for b in _BLANK}
_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives a task and serves the next one."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """The documents without their text, with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``input_ids``.

    ``vocabulary`` is a file that every executor has at that path.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_tokens", "ids_sha256", "decoded_sha256", "input_ids")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                        *(["input_ids array<int>"] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        for batch in batches:
            for part in slices(batch, text, 500_000):
                texts = Texts(part.column(part.schema.get_field_index(text)))
                data = texts.data.tobytes()
                counts, ids, decoded, arrays = [], [], [], []
                for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist()):
                    n, ids_text, decoded_text = encode_text(encoder, data[a:b], cuts(texts.data[a:b]).tolist())
                    counts.append(n)
                    ids.append(hashlib.sha256(ids_text).hexdigest())
                    decoded.append(hashlib.sha256(decoded_text).hexdigest())
                    if with_ids:
                        arrays.append(np.array(ids_text.split(), np.int32))
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                columns += [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names = [*(f.name for f in kept), "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]))))
                    names.append("input_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "input_ids", out: str = "text") -> DataFrame:
    """Adds the decoded text of each array of ids; a null array gives an empty text."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder_for(vocabulary).tokenizer
        for batch in batches:
            values = [tokenizer.decode(x or [], skip_special_tokens=False) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)
