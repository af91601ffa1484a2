"""Near-duplicate detection with dart signatures.

A document is a weighted set of word shingles: five words each, A-Z lower-cased, weight 1 for presence or
the number of occurrences. Darts are points of a random process in the plane of weight and rank, one plane
per shingle, cut into weight regions [0, 1), [1, 2), [2, 4), ...; a dart counts for a set if its weight lies
under the shingle's weight there. Each dart also carries a coordinate of the signature. The earliest dart
of every coordinate is the signature: two sets agree on a coordinate with the probability of their weighted
Jaccard similarity. Darts of a region come in the order of their ranks and are only thrown up to the rank
below which every coordinate is expected to be filled, so that the work is the number of shingles plus
about ``K ln K`` darts, not their product; coordinates still open are filled by throwing on to twice that
rank.

Signatures are cut into bands. Equal texts are one class from the start. Every class that shares a band
is compared exactly with one center of that bucket, which is one pair per member, and components of the
accepted links are found. What is left are pairs that share a bucket but lie in different components: members of
one center that may be similar by their distances from it (see ``undecided``) are joined on the keys of exact prefixes (see ``prefixes``), which no pair of the threshold escapes, first
with one member of each key, then all with all across components; exact bounds decide most of these pairs, the others
are compared. So the components are those of all similar pairs that share a band. No pair within a component is ever made.

Defined results: a null text is an empty one; texts of fewer than five but at least one word are one
shingle of all their words; texts without words are only alike if they are equal; null doc_ids come first;
rows with equal texts are one class, however often they repeat; an empty table gives an empty table; only
doc_id and the text are read, and columns that are kept keep their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.llm.components import components
from aerolake.llm.text import Texts, chained, mix, slices
from aerolake.llm.tables import shielded
from aerolake.session import cut

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of so many coordinates each: a pair of similarity 0.8 shares none with probability (1 - 0.8^4)^22 < 1e-5.
BANDS, ROWS = 22, 4
K = BANDS * ROWS

_UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * _UNIT


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count): the distinct shingles of every text, in the order of the text and of the hash."""
    texts.words()
    words = texts.word_hashes()
    at, owner = texts.windows(size)
    key = np.zeros(len(at), np.uint64)
    for step in range(size):
        key = chained(key, words[at + step])
    n_words = np.diff(texts.first)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for step in range(size):
            more = n_words[short] > step
            extra[more] = chained(extra[more], words[texts.first[short[more]] + step])
        owner, key = np.concatenate([owner, short]), np.concatenate([key, mix(extra)])
    if not len(key):
        return owner, key, np.zeros(0, np.int64)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return owner[first], key[first], np.diff(np.append(first, len(key)))


def dart_signatures(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int = K, seed: int = 0) -> np.ndarray:
    """n x k identities of the earliest darts; rows of texts without shingles are zero.

    ``weight`` may be any positive numbers. Regions of weight are [0, 1) and [2^i, 2^(i+1)).
    """
    best_rank = np.full(n * k, np.inf)
    best_dart = np.zeros(n * k, np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    todo = total > 0
    limit = np.zeros(n)
    limit[todo] = k * (np.log(k) + 2.0) / total[todo]
    begun = np.zeros(n)  # ranks below are done
    levels = np.maximum(0, np.ceil(np.log2(np.maximum(weight, 1.0)))).astype(np.int64)
    while todo.any():
        for level in range(int(levels.max(initial=0)) + 1):
            low = 0.0 if level == 0 else 2.0 ** (level - 1)
            width = 1.0 if level == 0 else low
            live = np.flatnonzero((levels >= level) & todo[owner])
            h = mix(key[live] + np.uint64((seed * 0x9E3779B97F4A7C15 + (level + 1) * 0xD1B54A32D192ED03) % 2**64))
            rank = np.zeros(len(live))
            while len(live):
                # The next dart of every region that is still below its text's limit.
                h = mix(h + np.uint64(0x632BE59BD9B4E019))
                rank = rank - np.log(_uniform(h)) / width
                on = rank <= limit[owner[live]]
                live, h, rank = live[on], h[on], rank[on]
                place = mix(h ^ np.uint64(0xA0761D6478BD642F))
                under = (low + width * _uniform(place) <= weight[live]) & (rank > begun[owner[live]])
                dart, at = h[under], rank[under]
                slot = owner[live[under]] * k + (mix(dart) % np.uint64(k)).astype(np.int64)
                # Earliest per coordinate; of equal ranks the smaller identity.
                order = np.lexsort((dart, at, slot))
                slot, at, dart = slot[order], at[order], dart[order]
                first = np.ones(len(slot), bool)
                first[1:] = slot[1:] != slot[:-1]
                slot, at, dart = slot[first], at[first], dart[first]
                better = (at < best_rank[slot]) | ((at == best_rank[slot]) & (dart < best_dart[slot]))
                best_rank[slot[better]], best_dart[slot[better]] = at[better], dart[better]
        open_rows = np.isinf(best_rank.reshape(n, k)).any(axis=1) & (total > 0)
        todo = open_rows
        begun[todo], limit[todo] = limit[todo], 2 * limit[todo]
    return best_dart.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands hashes of the bands' coordinates; the band's number is part of the hash."""
    rows = signatures.reshape(len(signatures), bands, -1)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        out = chained(out, rows[:, :, i])
    return out


def _print(text: str):
    """Fingerprint of a text; a null one is empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _known(doc):
    """A document number that equi-joins may use; null is the least number."""
    return F.coalesce(doc, F.lit(-(2**63)))


def signed_documents(docs: DataFrame, weighting: str = "presence", text: str = "text") -> DataFrame:
    """(m_doc, m_print, m_bands): document, fingerprint of its text, band hashes (empty without words). Narrow."""
    rows = docs.select(F.col("doc_id").cast("long").alias("m_doc"), _print(text).alias("m_print"), F.col(text).alias("m_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "m_text"):
                owner, key, count = shingles(Texts(part.column(2), lower=True))
                weight = count.astype(np.float64) if weighting == "count" else np.ones(len(count))
                keys = band_keys(dart_signatures(owner, key, weight, part.num_rows)).view(np.int64)
                full = np.bincount(owner, minlength=part.num_rows) > 0
                offsets = pa.array(np.cumsum(np.append(0, full * BANDS)), pa.int32())
                bands = pa.ListArray.from_arrays(offsets, pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bands], names=["m_doc", "m_print", "m_bands"])

    return rows.mapInArrow(run, "m_doc bigint, m_print string, m_bands array<bigint>")


def shingle_sets(docs: DataFrame, text: str) -> DataFrame:
    """(c, center, member, keys, counts) of documents (c, center, member, text): shingles sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                owner, key, count = shingles(Texts(part.column(3), lower=True))
                offsets = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (key.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *lists], names=["c", "center", "member", "keys", "counts"])

    return docs.select("c", "center", "member", text).mapInArrow(run, "c bigint, center boolean, member boolean, keys array<bigint>, counts array<int>")


def similarity(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets with sorted distinct keys."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low, high = np.minimum(wa[i], wb[j]).sum(), np.maximum(wa[i], wb[j]).sum()
    union = wa.sum() + wb.sum() - (low + high) + high
    return float(low / union) if union else 0.0


def _compared(pairs: DataFrame, lefts: DataFrame, rights: DataFrame, weighting: str) -> DataFrame:
    """The pairs (a, b) with their exact similarity ``s``; the size of a's set; of b its weight, its weight ``inside`` a's
    shingles, and bit cells of what it lacks and adds (see ``_possible``). ``lefts`` hold all sets of a, ``rights`` those of b."""
    left = lefts.select(F.col("c").alias("a"), F.col("keys").alias("ka"), F.col("counts").alias("wa"))
    right = rights.select(F.col("c").alias("b"), F.col("keys").alias("kb"), F.col("counts").alias("wb"))
    rows = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ka", "kb", "wa", "wb")
    names = ["a", "b", "s", "center_size", "weight", "inside", *MARKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, COMPARED_ROWS) for whole in batches for at in range(0, whole.num_rows, COMPARED_ROWS)):
            told = []
            for ka, kb, wa, wb in zip(*(batch.column(i) for i in range(2, 6))):
                x, y = np.asarray(ka.values), np.asarray(kb.values)
                u, v = (np.asarray(w.values).astype(np.int64) if weighting == "count" else np.ones(len(k), np.int64) for w, k in ((wa, x), (wb, y)))
                gone, new = x[~np.isin(x, y, assume_unique=True)], ~np.isin(y, x, assume_unique=True)
                told.append((similarity(x, y, u, v), len(x), int(v.sum()), int(v[~new].sum()), *_cells(gone), *_cells(y[new])))
            column = lambda i: pa.array([t[i] for t in told], pa.int64() if i else pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(column, range(8))], names=names)

    return rows.mapInArrow(run, "a bigint, b bigint, s double, center_size bigint, weight bigint, inside bigint, " + ", ".join(f"{m} bigint" for m in MARKS))


#: Pairs that are compared before their results are handed on.
COMPARED_ROWS = 500
#: Members of one key that are met by others in one cell; keys of more members are spread over several cells, to the same pairs.
CELL_ROWS = 2_000
MARKS = [f"{kind}{i}" for kind in ("gone", "new") for i in range(2)]
#: Cells of the screen for every wanted text, and the words of 64 cells that are broadcast at most. Beyond so many texts it lets more others pass.
SCREEN_CELLS, SCREEN_WORDS = 16, 2**19


def _cells(keys: np.ndarray) -> list[int]:
    """128 bits, one per cell that some key falls into: never more bits than keys."""
    bits = np.zeros(128, bool)
    bits[keys & 127] = True
    return np.packbits(bits).view(np.int64).tolist()


def screened(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose (m_print, m_doc) may be among the ``wanted``, a written table: all that are, and few others.

    Most texts share no band with another. A bitmap of the wanted ones is broadcast, so that their texts are not shuffled
    to find that out; who needs the wanted ones alone joins them after.
    """
    words = min(2 ** (wanted.count() * SCREEN_CELLS // 64).bit_length(), SCREEN_WORDS)
    cell = F.xxhash64("m_print", "m_doc")
    at = {"word_": cell.bitwiseAND(F.lit(words - 1)), "bit_": F.shiftrightunsigned(cell, 58).cast("int")}
    screen = wanted.withColumns(at).groupBy("word_").agg(F.bit_or(F.expr("shiftleft(1L, bit_)")).alias("bits_"))
    return texts.withColumns(at).join(F.broadcast(screen), "word_").filter(F.getbit("bits_", "bit_") == 1).select(*texts.columns)


def star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): every class b that shares a band with others, with the center a of each of its buckets.

    The center of a bucket is the class whose buckets hold the most classes in all: an original that many copies
    were made from shares bands with most of them, a copy with fewer. Counts only; no pair within a bucket but these.
    """
    rows = classes.select("c", F.explode("bands").alias("band"))
    sizes = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = cut(rows.join(sizes, "band"))
    reach = cut(shared.groupBy("c").agg(F.sum("n").alias("reach")))
    centers = cut(shared.join(reach, "c").groupBy("band").agg(F.max(F.struct("reach", "c")).alias("top")).select("band", F.col("top.c").alias("a")))
    return shared.join(centers, "band").filter("c <> a").select("a", F.col("c").alias("b")).distinct()


def undecided(compared: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """The members b of centers a, with their components, that may have the threshold with a's member of another component.

    One less the similarity is a metric, so the distances of two similar members from the center differ by no more than one
    less the threshold; and the lighter one has at least the threshold's part of the other's weight. So their cells of
    distance and of the weight's logarithm are at most two and one apart. Cells are aggregated; no pair of members is made.
    """
    ring, size = (1.0 - threshold) / 2 + 1e-6, 1e-6 - math.log(threshold)
    cells = {"ring": F.floor((1.0 - F.col("s")) / ring), "size": F.floor(F.log("weight") / size)}
    placed = cut(_placed(compared, roots).withColumns(cells))
    held = placed.groupBy("a", *cells).agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    for cell, reach in (("ring", 2), ("size", 1)):
        held = held.withColumn(cell, F.explode(F.sequence(F.col(cell) - reach, F.col(cell) + reach)))
    mixed = held.groupBy("a", *cells).agg(F.min("r0").alias("r0"), F.max("r1").alias("r1")).filter("r0 <> r1").select("a", *cells)
    return placed.join(mixed, ["a", *cells], "left_semi").drop(*cells)


def prefixes(placed: DataFrame, sets: DataFrame, threshold: float, weighting: str) -> DataFrame:
    """(a, key, b, rest, ..facts): of the undecided members b of centers a the keys of their prefixes.

    Members of different components only share keys that a center's members of several components have. Let all members
    have these in one order, the rarest of the center's members first: if two members have at least the threshold, the keys
    from their first common one on weigh at least the threshold's part of either set. So it is among the keys of which
    each and those after it (``rest``) weigh as much: the prefix. No such pair is missed, however many members a center has.
    """
    held = sets.select(F.col("c").alias("b"), F.arrays_zip("keys", "counts").alias("items"))
    held = placed.select("a", "b", "root", "weight").join(held, "b").select("a", "b", "root", "weight", F.explode("items").alias("item"))
    held = held.select("a", "b", "root", "weight", F.col("item.keys").alias("key"), (F.col("item.counts") if weighting == "count" else F.lit(1)).cast("long").alias("w"))
    live = held.groupBy("a", "key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("a", "key", "n")
    after = Window.partitionBy("a", "b").orderBy(F.desc("n"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = held.join(live, ["a", "key"]).withColumn("rest", F.sum("w").over(after)).filter(F.col("rest") >= threshold * F.col("weight") - 1e-6)
    return kept.select("a", "key", "b", "rest").join(placed.drop("s", "root"), ["a", "b"])


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of members b with their components."""
    return rows.join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))


def _possible(threshold: float, weighting: str) -> F.Column:
    """Whether members b and b_x of a center, in different components, may have the threshold by exact bounds.

    They share what both have of the center's shingles at most, and what both add; unions have at least as many
    shingles as their bit cells have bits; and from their first common key on they share ``rest`` at most.
    """
    common = F.least("inside", "inside_x") + F.least(F.col("weight") - F.col("inside"), F.col("weight_x") - F.col("inside_x"))
    if weighting == "presence":
        def bits(kind: str) -> F.Column:
            return F.bit_count(F.col(f"{kind}0").bitwiseOR(F.col(f"{kind}0_x"))) + F.bit_count(F.col(f"{kind}1").bitwiseOR(F.col(f"{kind}1_x")))

        both_added = F.col("weight") - F.col("inside") + F.col("weight_x") - F.col("inside_x") - bits("new")
        common = F.least(common, F.least("inside", "inside_x", F.col("center_size") - bits("gone")) + both_added)
    share = threshold / (1.0 + threshold)
    return (F.col("root") != F.col("root_x")) & (F.least(common, "rest", "rest_x") >= share * (F.col("weight") + F.col("weight_x")) - 1e-6)


def across(keyed: DataFrame, roots: DataFrame, threshold: float, weighting: str, drawn: bool) -> DataFrame:
    """(a, b): the possible pairs that share a key of their prefixes and lie in different components.

    Of the members of a key those outside its largest component meet all of it, in cells of ``CELL_ROWS`` times
    ``CELL_ROWS`` members; with ``drawn``, one of them alone does: a linear round that joins most of what is to be joined.
    """
    keyed = _placed(keyed, roots)
    parts = keyed.groupBy("a", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.xxhash64("key", "b").alias("h"), "b")).alias("one"))
    sizes = parts.groupBy("a", "key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).filter("parts > 1")
    sizes = sizes.select("a", "key", F.col("n"), F.col("most.root").alias("most"), (F.col("n") - F.col("most.n")).alias("outside"))
    if drawn:
        one = parts.join(sizes.select("a", "key", "most"), ["a", "key"]).filter("root <> most").groupBy("a", "key").agg(F.max("one").alias("one"))
        sizes = sizes.join(one.select("a", "key", F.col("one.b").alias("one")), ["a", "key"])
        outer, outside = F.col("b") == F.col("one"), F.lit(1)
    else:
        outer, outside = F.col("root") != F.col("most"), F.col("outside")
    rows = cut(keyed.join(sizes.select("a", "key", "most", F.ceil(F.col("n") / CELL_ROWS).alias("cells"), F.ceil(outside / CELL_ROWS).alias("cells_x"),
                                       *(["one"] if drawn else [])), ["a", "key"]).withColumn("outer", outer).drop("one"))
    facts = ["b", "root", "weight", "inside", "rest", "outer", *(MARKS if weighting == "presence" else [])]

    def dealt(to: str, own: F.Column, other: str) -> list[F.Column]:
        return [F.pmod(F.xxhash64("b", "key"), own).alias(to), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("j" if to == "i" else "i")]

    met = rows.filter("outer").select("a", "key", *[F.col(c).alias(f"{c}_x") for c in facts], *dealt("i", F.col("cells_x"), "cells"))
    rows = rows.select("a", "key", "center_size", *facts, *dealt("j", F.col("cells"), "cells_x"))
    pairs = rows.join(met, ["a", "key", "i", "j"]).filter(_possible(threshold, weighting) & (~F.col("outer") | (F.col("b") < F.col("b_x"))))
    return pairs.select(F.least("b", "b_x").alias("a"), F.greatest("b", "b_x").alias("b")).distinct()


def classify(docs: DataFrame, threshold: float = SIMILARITY, weighting: str = "presence", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The signed documents (m_doc, m_print, ..) and the verdicts on their texts, both as written tables.

    Verdicts: v_print; text_class, the smallest doc_id with that text; n_links, the links accepted for it, which are
    those to centers of buckets and the few compared after them, not all texts that are similar to it;
    class_id, the smallest text_class of its component; v_kept, whether the text is the one of its component that stays.
    """
    signed = cut(signed_documents(docs, weighting, text))
    classes = cut(signed.groupBy("m_print").agg(F.min("m_doc").alias("first_doc"), F.first("m_bands").alias("bands"))
                  .withColumn("c", F.xxhash64("m_print")))
    stars = cut(star_pairs(classes))
    roles = F.array(F.struct(F.col("a").alias("c"), F.lit(True).alias("center")), F.struct(F.col("b").alias("c"), F.lit(False).alias("center")))
    wanted = stars.select(F.explode(roles).alias("r")).groupBy("r.c").agg(F.max("r.center").alias("center"), F.max(~F.col("r.center")).alias("member"))
    texts = docs.select(_print(text).alias("m_print"), _known(F.col("doc_id").cast("long")).alias("m_doc"), F.coalesce(F.col(text), F.lit("")).alias("m_text"))
    chosen = cut(classes.select("c", "m_print", _known(F.col("first_doc")).alias("m_doc")).join(wanted, "c"))
    held = screened(texts, chosen).join(chosen, ["m_print", "m_doc"]).dropDuplicates(["m_print", "m_doc"]).select("c", "center", "member", "m_text")
    sets = cut(shingle_sets(held, "m_text"))
    members = sets.filter("member")
    compared = cut(_compared(stars, sets.filter("center"), members, weighting))
    links = compared.filter(F.col("s") >= threshold).select("a", "b")
    roots = cut(components(links))
    placed = cut(undecided(compared, roots, threshold))
    # From here on only their sets are shuffled.
    members = cut(members.join(placed.select(F.col("b").alias("c")).distinct(), "c", "left_semi"))
    keyed = cut(prefixes(placed, members, threshold, weighting))
    for drawn in (True, False):
        pairs = cut(across(keyed, roots, threshold, weighting, drawn))
        more = cut(_compared(pairs, members, members, weighting).filter(F.col("s") >= threshold).select("a", "b"))
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = cut(components(links))

    ends = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n_links"))
    placed = classes.select("c", "m_print", "first_doc").join(roots.withColumnRenamed("node", "c"), "c", "left").join(ends, "c", "left").withColumn("root", F.coalesce("root", "c"))
    clusters = placed.groupBy("root").agg(F.min(F.struct("first_doc", "c")).alias("best"))
    verdict = placed.join(clusters, "root").select(
        F.col("m_print").alias("v_print"), F.col("first_doc").alias("text_class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("best.first_doc").alias("class_id"), (F.col("c") == F.col("best.c")).alias("v_kept"))
    return signed, cut(verdict)


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, weighting: str = "presence", text: str = "text") -> DataFrame:
    """(doc_id, class_id, text_class, n_links, kept): a row per row of ``docs``; ``kept``: the document's text stays and
    its doc_id is the smallest with that text."""
    signed, verdict = classify(docs, threshold, weighting, text)
    joined = signed.select("m_doc", "m_print").join(verdict, F.col("m_print") == F.col("v_print"))
    return joined.select(F.col("m_doc").alias("doc_id"), "class_id", "text_class", "n_links",
                         (F.col("v_kept") & F.col("m_doc").eqNullSafe(F.col("text_class"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, threshold: float = SIMILARITY, weighting: str = "presence", text: str = "text") -> DataFrame:
    """One document of every class, with its own columns: the smallest doc_id, and one row of it if it repeats."""
    return shielded(docs, ("doc_id", text), lambda rows: _keep_one(rows, threshold, weighting, text))


def _keep_one(docs: DataFrame, threshold: float, weighting: str, text: str) -> DataFrame:
    _, verdict = classify(docs, threshold, weighting, text)
    stay = verdict.filter("v_kept").select(F.col("v_print").alias("m_print_"), _known(F.col("text_class")).alias("m_doc_"))
    rows = docs.withColumns({"m_print_": _print(text), "m_doc_": _known(F.col("doc_id").cast("long"))})
    return rows.join(stay, ["m_print_", "m_doc_"]).dropDuplicates(["m_print_", "m_doc_"]).select(*docs.columns)
