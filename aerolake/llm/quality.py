"""Quality rules with host-level verdicts.

Every document is measured by itself, hosts are judged by the share of their documents that fail, and
the host's verdict goes back to its documents. A host with few documents says little about itself, so
its rate is shrunk toward the rate of all hosts by a beta prior fitted to the hosts.

Defined results: a null text has no words and fails; documents whose host is null form one host;
repeated rows are measured and counted each; an empty table gives an empty table; columns beside the
ones used are carried along, except that columns added here replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.text import Texts, chained, later_copies, mask_of, mix, slices, span_hashes, twice_or_more
from aerolake.llm.tables import shielded, without
from aerolake.session import cut

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
#: A document fails if more than this share of its words stands in repeated three-word windows.
MAX_REPEATED_PERCENT = 50
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Rows of one host are dealt to this many tasks in the join with the verdicts.
SALTS = 32

_SYMBOLS = mask_of(b"#*$%&|<>")
_NEWLINE = 10


def _measures(column: pa.Array) -> list[np.ndarray]:
    texts = Texts(column)
    texts.words()
    points = (texts.data & 0xC0) != 0x80
    n_words = np.diff(texts.first)

    breaks = np.flatnonzero(texts.data == _NEWLINE)
    starts = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, texts.offsets[1:]]))
    worded = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    starts, ends = starts[worded], ends[worded]
    owner = np.searchsorted(texts.offsets, starts, side="right") - 1
    again = later_copies(chained(mix(owner.astype(np.uint64)), span_hashes(texts.data, starts, ends)))

    words = texts.word_hashes()
    at, of = texts.windows(3)
    keys = chained(chained(chained(mix(of.astype(np.uint64)), words[at]), words[at + 1]), words[at + 2])
    found = at[twice_or_more(keys)]
    covered = np.zeros(len(words), bool)
    for step in range(3):
        covered[found + step] = True
    return [n_words, texts.per_text(texts.inside & points), texts.per_text(_SYMBOLS[texts.data]),
            np.bincount(owner[again], minlength=texts.n), texts.per_text_words(covered)]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the five measures as columns ``q_<measure>``; a narrow pass over whole texts."""
    docs = without(docs, [f"q_{m}" for m in MEASURES])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"q_{m} bigint" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                values = _measures(part.column(part.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, pa.int64()) for v in values)],
                                                 names=[*part.schema.names, *(f"q_{m}" for m in MEASURES)])

    return docs.mapInArrow(run, schema)


def failed() -> F.Column:
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEATED_PERCENT * F.col("q_n_words"))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """(q_host, q_docs, q_fails, q_rate): the shrunk failure rate of every host.

    The prior Beta(a, b) has the mean of all documents and the between-host variance left after the
    binomial noise is taken off (method of moments). Its fit is four sums over hosts, so that only
    these four numbers reach the driver.
    """
    hosts = cut(measured.groupBy(F.col(host).alias("q_host")).agg(
        F.count(F.lit(1)).alias("q_docs"), F.sum(failed().cast("long")).alias("q_fails")))
    n, f = F.col("q_docs"), F.col("q_fails")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("docs"), F.sum(f).alias("fails"),
                     F.sum(n * n).alias("squares"), F.sum(f * f / n).alias("spread")).first()
    a, b = beta_prior(*(sums[k] or 0 for k in ("hosts", "docs", "fails", "squares", "spread")))
    return hosts.withColumn("q_rate", (f + F.lit(a)) / (n + F.lit(a + b)))


def beta_prior(hosts: float, docs: float, fails: float, squares: float, spread: float) -> tuple[float, float]:
    """(a, b) of the prior. ``squares``: sum of n^2, ``spread``: sum of f^2/n over hosts.

    With one host, or hosts that differ no more than chance, the prior weighs as much as all
    documents: every host then has nearly the common rate. Half a success and half a failure keep
    the mean off 0 and 1.
    """
    mean = (fails + 0.5) / (docs + 1.0)
    noise = mean * (1.0 - mean)
    most = max(float(docs), 1.0)
    between = spread - docs * mean * mean if docs else 0.0
    scale = docs - squares / docs if docs else 0.0
    variance = (between - (hosts - 1) * noise) / scale if scale > 0 else 0.0
    strength = min(most, max(1.0, noise / variance - 1.0)) if variance > 0 else most
    return mean * strength, (1.0 - mean) * strength


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Documents with measures, ``q_failed``, ``q_host_rate`` and ``q_kept``. Texts are not carried.

    The measures are written once; host verdicts are joined to them on (host, salt), each host copied
    to ``SALTS`` rows, so that a host with a third of all documents is spread over many tasks.
    """
    measured = cut(measure(without(docs, ("q_host", "q_host_rate", "q_salt", "q_salt_h", "q_failed", "q_kept")), text).drop(text))
    verdicts = host_rates(measured, host).select(
        "q_host", F.col("q_rate").alias("q_host_rate"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("q_salt_h"))
    rows = measured.withColumn("q_salt", F.pmod(F.xxhash64(*[c for c in measured.columns]), F.lit(SALTS)).cast("int"))
    joined = rows.join(verdicts, F.col(host).eqNullSafe(F.col("q_host")) & (F.col("q_salt") == F.col("q_salt_h")), "left")
    return joined.withColumn("q_failed", failed()).withColumn(
        "q_kept", ~failed() & (F.col("q_host_rate") <= max_host_rate)).drop("q_host", "q_salt", "q_salt_h")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with their own columns. Texts are not shuffled: they are measured a
    second time, and only the rejected hosts are joined."""
    return shielded(docs, (host, text), lambda rows: _keep_good(rows, host, text, max_host_rate))


def _keep_good(docs: DataFrame, host: str, text: str, max_host_rate: float) -> DataFrame:
    names = docs.columns
    hosts = host_rates(cut(measure(docs.select(host, text), text).drop(text)), host)
    bad = hosts.filter(F.col("q_rate") > max_host_rate).select(
        F.coalesce(F.xxhash64(F.col("q_host")), F.lit(0)).alias("q_key"), F.col("q_host").alias("q_bad"))
    good = measure(docs, text).filter(~failed())
    if bad.isEmpty():
        return good.select(*names)
    spread = bad.select("q_bad", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("q_salt_h"))
    salted = good.withColumn("q_salt", F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col(host).eqNullSafe(F.col("q_bad")) & (F.col("q_salt") == F.col("q_salt_h")), "left_anti").select(*names)
