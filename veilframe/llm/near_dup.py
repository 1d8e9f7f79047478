"""Near-duplicates by Order MinHash and banded alignment (operator 3).

A document's k-mers are its shingles of five words (A-Z lower-cased), labelled
with their occurrence number, so that each is unique in the document. Each of
``BANDS`` sketches takes the two k-mers with the smallest hashes and keeps them
in text order; documents that share a sketch are candidates. Sharing one needs
the same k-mers in the same order, so the sketches follow edit similarity.

Candidates are verified on whole texts by edit similarity: their word sequences
are aligned in the diagonal band that a similarity of 0.8 allows, and the similarity
is the aligned words over all words of both. It is at least the share of aligned shingles,
so every pair whose shingles are alike by 0.8 in order is alike. Equal word sequences
are one node and need no pair.

Inside a bucket each node is first compared with a few representatives: the most
central node, whose buckets are the largest (the one that the others are copies
of), and two drawn at random, others in each bucket. Links are merged to classes
by rounds of smallest labels. Then every other pair of a bucket that is still in two
classes is decided: buckets of several classes are cut into blocks (large ones by length
first, as texts alike differ little in it), all pairs of blocks are tested by a proven
bound (the parities of two texts' words differ in no more places than the texts differ
in words), and the pairs that pass are verified on whole texts. So texts alike that
share a sketch always meet in a class, and the classes depend on the texts alone.

No bucket, class or list of links meets in one task or the driver; skewed joins read
checkpointed tables on both sides, so that adaptive execution can split them.

Rows are numbered once and written to the shared folder with their numbers, by
which they are told apart from then on; a lost executor can't renumber them. The
tables of the rounds are removed when the classes are known.

Null, empty and wordless texts are a class each. Texts under five words have one
k-mer, all their words. The class id is the smallest document id of the class.
Repeated rows are copies; rows without an id get the class of their text.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import scratch
from veilframe.llm import text as tx
from veilframe.operators.joins import sized_join

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
#: Representatives of a bucket besides its most central node.
DRAWS = 2
#: Parity bits of a node: two to four for each word, between these bounds.
PARITY_BITS = (64, 1 << 16)
#: Bytes of parities in a block of a bucket.
BLOCK_BYTES = 40_000
#: A large bucket's nodes are cut at lengths this factor apart, so that texts alike are at most one cut apart.
LENGTHS = 1.001 / SIMILARITY
#: With more pairs left than this, a part of them is verified first, which joins most classes.
MANY_PAIRS, FIRST_PART = 100_000, 16
SEED = 3

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(2**64 - 1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words in text order, and the rows' offsets."""
    data, offsets = tx.utf8(texts)
    starts, ends = tx.runs(data, offsets, tx.WORD_BYTES)
    n = np.bincount(tx.row_of(starts, offsets), minlength=len(texts))
    return tx.mix(tx.span_hashes(data, starts, ends)), np.concatenate([[0], np.cumsum(n)])


def labelled(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashes mixed with their occurrence number among the equal ones of their row, in order of place."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = tx.mix(hashes + row.astype(np.uint64) * _STEP)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    index = np.arange(len(key))
    occurrence = np.empty(len(key), np.uint64)
    occurrence[order] = index - np.maximum.accumulate(np.where(new, index, 0))
    return tx.mix(hashes + occurrence * _STEP)


def kmers(words: np.ndarray, first: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of all rows in text order, and the rows' offsets."""
    n = np.diff(first)
    sizes = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    at = tx.spread(first[:-1], sizes)
    end = np.repeat(first[1:], sizes)
    padded = np.concatenate([words, np.zeros(shingle, np.uint64)])
    hashes = np.zeros(len(at), np.uint64)
    for j in range(shingle):
        hashes = tx.mix(hashes * _STEP + np.where(at + j < end, padded[at + j], np.uint64(j + 1)))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return labelled(hashes, offsets), offsets


def sequence_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two hashes of each row's word sequence."""
    rise = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64) + np.uint64(1)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(tx.mix(words * salt + rise))]) for salt in (_STEP, _MULTIPLY[0])]
    return np.stack([x[first[1:]] - x[first[:-1]] for x in sums], 1)


def sketches(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The order sketches of rows that have k-mers: (rows, bands) of 64-bit values."""
    starts, sizes = offsets[:-1], np.diff(offsets)
    out = np.empty((len(sizes), BANDS), np.uint64)
    for band in range(BANDS):
        h = (marked ^ _XOR[band]) * _MULTIPLY[band]
        low, place = [], []
        for _ in range(2):
            least = np.minimum.reduceat(h, starts)
            where = np.flatnonzero(h == np.repeat(least, sizes))
            at = np.full(len(sizes), np.iinfo(np.int64).max)
            at[np.searchsorted(offsets, where, "right")[::-1] - 1] = where[::-1]
            h[at] = _NONE
            low.append(least)
            place.append(at)
        ahead = place[0] <= place[1]
        one, two = np.where(ahead, low[0], low[1]), np.where(ahead, low[1], low[0])
        out[:, band] = tx.mix(tx.mix(one) * _STEP + two)
    return out


def alike(a: np.ndarray, b: np.ndarray, marked_a: np.ndarray, marked_b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two word sequences' alignment has a similarity of ``least``: aligned words over all words of both.

    ``marked_*`` are the words with their occurrence numbers. Those that both
    have bound the alignment from above, their longest chain that rises in both from
    below; between the bounds the words are aligned exactly.
    """
    total = len(a) + len(b)
    need = int(np.ceil(least / (1 + least) * total - 1e-9))
    if not total or need > min(len(a), len(b)):
        return False
    _, i, j = np.intersect1d(marked_a, marked_b, assume_unique=True, return_indices=True)
    if len(i) < need:
        return False
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all() or _longest_rise(j.tolist()) >= need:
        return True
    ids = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    return common(ids[: len(a)].tolist(), ids[len(a) :].tolist(), need) >= need


def common(a: list[int], b: list[int], need: int) -> int:
    """Longest common subsequence of ``a`` and ``b``, exact where it is at least ``need``.

    An alignment of ``need`` leaves at most ``len(a) - need`` and ``len(b) - need`` words
    over, so it strays no further from the diagonal. Rows of ``b`` are taken in blocks; a
    block's window of ``a`` is one integer, whose zero bits mark where the row's alignment grows.
    """
    below, above = len(b) - need, len(a) - need
    step = max(64, below + above)
    lo = hi = done = 0
    grown = 0
    for start in range(0, len(b), step):
        end = min(len(b), start + step)
        left, right = max(0, start - below), min(len(a), end + above)
        # what the window leaves behind is settled, what it takes in has not grown yet
        done += (left - lo) - (grown & ((1 << (left - lo)) - 1)).bit_count()
        grown = (grown >> (left - lo)) | (((1 << (right - hi)) - 1) << (hi - left))
        lo, hi = left, right
        full = (1 << (hi - lo)) - 1
        places: dict[int, int] = {}
        for k, w in enumerate(a[lo:hi]):
            places[w] = places.get(w, 0) | (1 << k)
        for w in b[start:end]:
            met = places.get(w, 0) & grown
            if met:
                grown = ((grown + met) | (grown - met)) & full
    return done + (hi - lo) - grown.bit_count()


def _longest_rise(values: list[int]) -> int:
    ends: list[int] = []
    for v in values:
        at = bisect.bisect_left(ends, v)
        ends[at : at + 1] = [v]
    return len(ends)


_SIGNED = tx.struct_of(("node", T.BinaryType()), ("n", T.LongType()), ("sketches", T.ArrayType(T.LongType(), False)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    for batch in batches:
        words, first = word_hashes(batch.column("text"))
        marked, offsets = kmers(words, first)
        both, n = sequence_hashes(words, first), np.diff(first)
        some = np.flatnonzero(n > 0)
        found = np.zeros((0, BANDS), np.uint64)
        if len(some):
            found = sketches(marked, np.concatenate([offsets[some], [offsets[-1]]]))
        node: list[bytes | None] = [None] * batch.num_rows
        for r in some.tolist():
            node[r] = both[r].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
        yield [
            pa.array(node, pa.binary()),
            pa.array(n),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.reshape(-1).view(np.int64))).cast(pa.list_(pa.field("element", pa.int64(), False))),
        ]


def sign(numbered: DataFrame) -> DataFrame:
    """Row, id, node (128-bit hash of the word sequence, null without words), number of words and sketches of each row."""
    found = tx.annotate(numbered.select("row", "doc_id", "text"), {"text": ("text", "string")}, _sign, _SIGNED)
    return found.select(F.col("doc.c0").alias("row"), F.col("doc.c1").alias("doc_id"), "node", "n", "sketches")


def _kept(frame: DataFrame, folder: str) -> DataFrame:
    """The rows read back from the run's folder: unlike a checkpoint's, their size estimate doesn't multiply from join to join."""
    path = f"{folder}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _numbered(docs: DataFrame, folder: str) -> DataFrame:
    """The rows with a number each, written to the shared folder, so that no later scan or lost task renumbers them."""
    docs.withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _shared(nodes: DataFrame) -> DataFrame:
    """Row, words, band and sketch of the nodes, for the sketches that several share."""
    rows = nodes.select("row", "n", F.posexplode("sketches").alias("band", "sketch"))
    sizes = rows.groupBy("band", "sketch").agg(F.count("*").alias("size")).where("size > 1").checkpoint()
    return rows.join(sizes, ["band", "sketch"]).checkpoint()


def _candidates(shared: DataFrame, least: float) -> DataFrame:
    """Pairs of a node's row (a) and that of a representative (b) of a bucket it is in, if their sizes allow the similarity."""
    central = shared.groupBy("row").agg(F.round(F.sum(F.log2("size")), 6).alias("central"))
    best = F.min(F.struct((-F.col("central")).alias("h"), "row", "n"))
    draws = [F.min(F.struct(F.xxhash64("row", "band", F.lit(d)).alias("h"), "row", "n")) for d in range(DRAWS)]
    # one value a bucket and task crosses the shuffle, however many rows the bucket has
    heads = shared.join(central, "row").groupBy("band", "sketch").agg(*[x.alias(f"r{i}") for i, x in enumerate([best, *draws])])
    each = F.array_distinct(F.array(*[F.struct(f"r{i}.row", f"r{i}.n") for i in range(1 + DRAWS)]))
    heads = heads.select("band", "sketch", each.alias("heads")).checkpoint()
    pairs = shared.join(heads, ["band", "sketch"]).select("row", "n", F.explode("heads").alias("head"))
    pairs = pairs.where((F.col("row") != F.col("head.row")) & (F.least("n", "head.n") >= least * F.greatest("n", "head.n")))
    return pairs.select(F.col("row").alias("a"), F.col("head.row").alias("b")).distinct()


_ROWS = tx.struct_of(("a", T.LongType()), ("b", T.LongType()))


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text_b"):
            a, first_a = word_hashes(batch.column("text_a"))
            b, first_b = word_hashes(batch.column("text_b"))
            marked_a, marked_b = labelled(a, first_a), labelled(b, first_b)
            at = zip(first_a[:-1].tolist(), first_a[1:].tolist(), first_b[:-1].tolist(), first_b[1:].tolist(), strict=True)
            keep = pa.array([alike(a[p:q], b[r:s], marked_a[p:q], marked_b[r:s], least) for p, q, r, s in at], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=_ROWS.names)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs of rows whose texts are alike."""
    with_b = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(least), _ROWS).checkpoint()


def parities(marked: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each row's labelled words dealt to a power of two of bits, with the parity of each bit's number of words."""
    sizes = np.diff(offsets)
    low, high = PARITY_BITS
    bits = np.clip(2 ** np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), low, high)
    first = np.concatenate([[0], np.cumsum(bits // 64)])
    place = marked & np.repeat(bits - 1, sizes).astype(np.uint64)
    words = np.zeros(first[-1], np.uint64)
    np.bitwise_xor.at(words, np.repeat(first[:-1], sizes) + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return [words[p:q].tobytes() for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _folded(parity: np.ndarray, width: int) -> np.ndarray:
    """Parities (n, words) over fewer bits."""
    while parity.shape[1] > width:
        half = parity.shape[1] // 2
        parity = parity[:, :half] ^ parity[:, half:]
    return parity


class _Block:
    def __init__(self, nodes: pa.StructArray):
        self.row, self.n, self.label = (nodes.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        parity = nodes.field(3).to_pylist()
        width = np.array([len(x) // 8 for x in parity])
        self.parts = []
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            self.parts.append((w, at, np.frombuffer(b"".join(parity[i] for i in at.tolist()), np.uint64).reshape(-1, w)))


def close(left: _Block, right: _Block, least: float) -> np.ndarray:
    """Rows (n, 2) of the pairs of other classes whose sizes and parities allow the similarity; a pair within one block once."""
    out = [np.zeros((0, 2), np.int64)]
    for wide_l, at_l, parity_l in left.parts:
        for wide_r, at_r, parity_r in right.parts:
            n_l, n_r = left.n[at_l][:, None], right.n[at_r][None, :]
            ok = (np.minimum(n_l, n_r) >= least * np.maximum(n_l, n_r)) & (left.label[at_l][:, None] != right.label[at_r][None, :])
            if left is right:
                ok &= left.row[at_l][:, None] < right.row[at_r][None, :]
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            width = min(wide_l, wide_r)
            a, b = _folded(parity_l, width), _folded(parity_r, width)
            step = max(1, (1 << 20) // width)
            differ = np.concatenate([np.bitwise_count(a[i[k : k + step]] ^ b[j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)])
            # words that only one of the two has: at least as many as parities that differ
            keep = differ <= (n_l[i, 0] + n_r[0, j]) * (1 - least) / (1 + least) + 1e-9
            out.append(np.stack([left.row[at_l[i[keep]]], right.row[at_r[j[keep]]]], 1))
    pairs = np.concatenate(out)
    return np.stack([pairs.min(1), pairs.max(1)], 1) if len(pairs) else pairs


_PARITY = tx.struct_of(("row", T.LongType()), ("parity", T.BinaryType()))


def _parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.slices(batches, "text"):
        words, first = word_hashes(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(parities(labelled(words, first), first), pa.binary())], names=_PARITY.names)


def _close(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left = _Block(batch.column("left")[k].values)
                other = batch.column("right")[k].values
                found = close(left, left if other is None else _Block(other), least)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=_ROWS.names)

    return run


def _left_open(shared: DataFrame, classes: DataFrame, texts: DataFrame, least: float, folder: str) -> DataFrame | None:
    """All pairs of rows of one bucket and two classes that may be alike (None without any such bucket)."""
    label = classes.select("row", F.col("label.row").alias("label"))
    known = shared.join(label, "row", "left").withColumn("label", F.coalesce("label", "row"))
    weight = F.sum(F.least(F.col("n") / 2, F.lit(PARITY_BITS[1] / 8)) + 24)
    step = max(LENGTHS, 1.001 / least)
    known = known.withColumn("cut", F.floor(F.log("n") / float(np.log(step))))
    # a bucket has as many cuts as there are lengths on a logarithmic scale
    cuts = known.groupBy("band", "sketch", "cut").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), weight.alias("weight"))
    blocks = F.map_from_entries(F.collect_list(F.struct("cut", F.ceil(F.col("weight") / BLOCK_BYTES))))
    mixed = cuts.groupBy("band", "sketch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size"), (F.sum("weight") > BLOCK_BYTES).alias("large"), blocks.alias("blocks"))
    # the nodes of a bucket of two have met as node and representative
    mixed = mixed.where("size > 2 and lo < hi").select("band", "sketch", "large", "blocks").checkpoint()
    if mixed.isEmpty():
        return None
    members = known.join(mixed, ["band", "sketch"]).withColumn("block", F.when(F.col("large"), F.pmod(F.xxhash64("row"), F.col("blocks")[F.col("cut")])).otherwise(0))
    members = members.withColumn("cut", F.when(F.col("large"), F.col("cut")).otherwise(0)).drop("blocks")
    members = members.withColumn("key", F.xxhash64("band", "sketch", "cut", "block")).checkpoint()
    chosen = sized_join(texts, members.select("row").distinct(), ["row"], "left_semi")
    parity = chosen.select("row", "text").mapInArrow(_parity, _PARITY)
    whole = members.join(parity, "row").groupBy("key").agg(F.collect_list(F.struct("row", "n", "label", "parity")).alias("nodes")).checkpoint()
    within = whole.select(F.col("nodes").alias("left"), F.lit(None).cast(whole.schema["nodes"].dataType).alias("right"))
    # a block meets the further blocks of its own lengths and all of the next ones
    names = members.where("large").select("band", "sketch", "cut", "block", "key").distinct().checkpoint()
    ahead = names.select("band", "sketch", "block", F.col("key").alias("key_l"), F.col("cut").alias("own"), F.explode(F.array("cut", F.col("cut") + 1)).alias("cut"))
    two = ahead.join(names.withColumnsRenamed({"block": "further", "key": "key_r"}), ["band", "sketch", "cut"])
    two = two.where("own < cut or block < further").select("key_l", "key_r").checkpoint()
    n = two.count()
    pairs = within.mapInArrow(_close(least), _ROWS)
    if n:
        parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 500)
        left = two.join(whole.select(F.col("key").alias("key_l"), F.col("nodes").alias("left")), "key_l").repartition(parts, "key_r", "key_l")
        right = whole.select(F.col("key").alias("key_r"), F.col("nodes").alias("right"))
        pairs = pairs.unionAll(left.join(right, "key_r").select("left", "right").mapInArrow(_close(least), _ROWS))
    return _kept(pairs.distinct(), folder)


def _settle(classes: DataFrame, labels: DataFrame, pairs: DataFrame, texts: DataFrame, least: float, folder: str) -> DataFrame:
    """The classes with all ``pairs`` decided: verified, unless their rows are in one class by then."""
    part = None
    while part != 1:
        of = classes.select("row", F.col("label.row").alias("label"))
        apart = pairs.select("a", "b")
        for end in ("a", "b"):
            apart = apart.join(of.withColumnsRenamed({"row": end, "label": f"label_{end}"}), end, "left")
        apart = apart.select("a", "b", *[F.coalesce(f"label_{end}", end).alias(f"label_{end}") for end in ("a", "b")])
        apart = _kept(apart.where("label_a != label_b"), folder)
        n = apart.count()
        if not n:
            break
        part = FIRST_PART if part is None and n > MANY_PAIRS else 1
        drawn = F.pmod(F.xxhash64("a", "b"), F.lit(part)) == 0
        chosen, pairs = apart.where(drawn), apart.where(~drawn)
        rows = chosen.select(F.col("a").alias("row")).unionAll(chosen.select("b")).distinct()
        more = _verified(chosen, sized_join(texts, rows, ["row"], "left_semi").checkpoint(), least)
        if not more.isEmpty():
            # the new links join whole classes, so only these take part in the rounds
            merged = connect(more.join(apart, ["a", "b"]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), labels, folder)
            known = classes.unionAll(merged.join(classes.select("row"), "row", "left_anti"))
            heads = merged.select(F.col("row").alias("head"), F.col("label").alias("further"))
            known = known.withColumn("head", F.col("label.row")).join(heads, "head", "left")
            classes = _kept(known.select("row", F.coalesce("further", "label").alias("label")), folder)
    return classes


def connect(links: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """Smallest label of each node's component, for the nodes in ``links`` (a, b).

    ``labels`` has (row, label) of all nodes; a label is a struct whose ``row``
    names a node. Each round hands labels over the links; from the third round
    on, nodes also take their label's own label, so that long chains close fast.
    """
    ways = links.select(F.col("a").alias("from"), F.col("b").alias("to")).unionAll(links.select("b", "a"))
    ways = _kept(ways, folder)
    current = _kept(labels.join(ways.select(F.col("from").alias("row")).distinct(), "row"), folder)
    turn = 0
    while True:
        turn += 1
        handed = ways.join(current, ways["from"] == current["row"]).select(F.col("to").alias("row"), "label", F.lit(None).cast(current.schema["label"].dataType).alias("own"))
        own = current.select("row", "label", F.col("label").alias("own"))
        # one value a node and task crosses the shuffle, however many links the node has
        lowered = _kept(handed.unionAll(own).groupBy("row").agg(F.min("label").alias("label"), F.min("own").alias("own")), folder)
        if lowered.where(F.col("label") != F.col("own")).isEmpty():
            return lowered.select("row", "label")
        current = lowered.select("row", "label")
        if turn > 2:
            heads = current.select(F.col("row").alias("head"), F.col("label").alias("further"))
            jumped = current.withColumn("head", F.col("label.row")).join(heads, "head", "left")
            current = _kept(jumped.select("row", F.least("label", "further").alias("label")), folder)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: its class id, its node's copies, and ``keep`` for one row of each class."""
    spark = docs.sparkSession
    folder = scratch.folder(spark, "near_dup_rows")
    found = _classes(_numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), folder), least)
    scratch.remove(spark, folder)
    return found


def _classes(numbered: DataFrame, least: float) -> DataFrame:
    spark = numbered.sparkSession
    folder = scratch.folder(spark, "near_dup")
    signed = sign(numbered).checkpoint()
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head")
    nodes = signed.where("node is not null").groupBy("node", "n", "sketches").agg(head, F.count("*").alias("copies"))
    nodes = nodes.select("node", "n", "sketches", "head", "head.row", "copies").checkpoint()
    labels, texts = nodes.select("row", F.col("head").alias("label")), numbered.select("row", "text")
    shared = _shared(nodes)
    links = _verified(_candidates(shared, least).checkpoint(), texts, least)
    classes = connect(links, labels, folder)
    pairs = _left_open(shared, classes, texts, least, folder)
    if pairs is not None:
        classes = _settle(classes, labels, pairs, texts, least, folder)
    label = F.coalesce("label", "head")
    known = nodes.select("row", "node", "head", "copies").join(classes, "row", "left").select(
        "node",
        label["doc_id"].alias("class_id"),
        label["row"].alias("head_row"),
        "copies",
    ).checkpoint()
    scratch.remove(spark, folder)
    for done in (shared, nodes):
        scratch.remove_checkpoint(done)
    out = signed.select("doc_id", "row", "node").join(known, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        (alone | F.coalesce(F.col("head_row") == F.col("row"), F.lit(False))).alias("keep"),
        "row",
    )


def remove_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents, in their own columns, without all but one row of each class."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c.lower(): n for n, c in reversed(list(zip(names, docs.columns, strict=True)))}
    numbered = _numbered(docs.toDF(*names), scratch.folder(docs.sparkSession, "near_dup_rows"))
    facts = numbered.select("row", F.col(place[doc_id.lower()]).alias("doc_id"), F.col(place[text.lower()]).cast("string").alias("text"))
    gone = _classes(facts, least).where("not keep").select("row").checkpoint()
    left = numbered.join(gone, "row", "left_anti")
    return left.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
