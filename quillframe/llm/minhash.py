"""Near-duplicate documents by compressed MinHash registers.

The shingle hashes of a document fall into buckets. Each bucket keeps its least
hash, compressed to a count of leading zeros and some mantissa bits. Bands of
registers give candidates, an estimate corrected for chance collisions thins
them out, and the full sets confirm them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quillframe.llm.components import connected_components
from quillframe.scratch import written

SHINGLE_WORDS = 5
#: Share of the union that two documents have in common, in hundredths.
LEAST_PERCENT = 80

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
EMPTY = 0xFFFF
#: 42 bands of 6 registers: of pairs with a similarity of 0.8, 3 in a million share none.
BANDS, BAND_REGISTERS = 42, 6
#: A set is hashed so often that it has about this many hashes, 16 for a bucket.
LEAST_HASHES = 4096
#: Standard deviations by which an estimate may fall short and is still verified: at a
#: similarity of 0.8 this loses fewer pairs than the bands do.
ESTIMATE_MARGIN = 5.5
#: Documents that are verified against one in a group of rows.
CHUNK = 64
PIECE_BYTES = 4 << 20
#: Members of a bucket in one block, and shingles that they have together.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 4 << 20

_WHITE = frozenset(b" \t\n\r\x0b\x0c")
_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, A-Z lower-cased."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data) and data[end - 1] not in _WHITE:
            end += 1
        words = data[at:end].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words.

    Fewer words are one run of their own. Two different runs share a hash with a
    chance of 2**-64; sets are compared by these hashes.
    """
    words = word_hashes(data)
    if not len(words):
        return words
    size = min(size, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = mixed * _K + words[k:len(words) - size + 1 + k]
    return np.unique(_mixed(mixed))


def size_classes(n: int, least_percent: int) -> list[int]:
    """Classes of a set of n: its power of two, and the one below if a similar smaller set may be there.

    Two similar sets share a class, in which both are hashed equally often.
    """
    top = LEAST_HASHES.bit_length() - 1
    own = min(n.bit_length() - 1, top)
    below = n.bit_length() == own + 1 and own > 0 and n * least_percent < 100 << own
    return [own - 1, own] if below else [own]


def registers(hashes: np.ndarray, size_class: int) -> np.ndarray:
    """Compressed register of each bucket: leading zeros, then mantissa bits."""
    times = max(1, LEAST_HASHES >> size_class)
    seeds = _mixed(np.arange(1, times + 1, dtype=np.uint64) * _K)
    every = np.sort(_mixed(hashes[None, :] ^ seeds[:, None]).ravel())
    low = np.uint64(64 - BUCKET_BITS)
    starts = np.arange(BUCKETS, dtype=np.uint64) << low
    first = np.searchsorted(every, starts)
    filled = first < len(every)
    least = every[np.where(filled, first, 0)]
    filled &= (least >> low) == np.arange(BUCKETS, dtype=np.uint64)
    # 53 bits below the bucket's: exact as floating point, whose exponent counts the zeros
    rest = (least << np.uint64(BUCKET_BITS)) >> np.uint64(11)
    zeros = 53 - np.frexp(rest.astype(np.float64))[1]
    mantissa = ((rest << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    found = (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa
    return np.where(filled, found, EMPTY).astype("<u2")


def chance_collision(n: int) -> float:
    """Chance that a bucket of two unrelated sets of n hashes has equal registers."""
    each = max(n / BUCKETS, 1e-9)
    zeros = np.arange(54, dtype=np.float64)[:, None]
    steps = 1 << MANTISSA_BITS
    low = (steps + np.arange(steps, dtype=np.float64)) / steps / 2.0 ** (zeros + 1)
    high = low + 2.0 ** -(zeros + 1) / steps
    held = np.exp(-each * low) - np.exp(-each * high)
    return float((held * held).sum())


class Estimator:
    """Similarity of two sets from registers, without what chance makes equal."""

    def __init__(self, least_percent: int):
        self.chance = {c: chance_collision(max(LEAST_HASHES, 1 << c) * 3 // 2) for c in range(LEAST_HASHES.bit_length())}
        share = least_percent / 100
        self.least = share - ESTIMATE_MARGIN * math.sqrt(share * (1 - share) / BUCKETS)

    def share(self, a: np.ndarray, b: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Estimated similarity of rows of registers."""
        used = (a != EMPTY) | (b != EMPTY)
        equal = ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
        chance = np.array([self.chance[c] for c in range(LEAST_HASHES.bit_length())])[classes]
        return (equal - chance) / (1 - chance)

    def similar(self, a: np.ndarray, b: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Which rows of registers may belong to sets that are similar enough."""
        return self.share(a, b, classes) >= self.least


# Signatures ---------------------------------------------------------------

SIGNATURES = (
    "id long, n_shingles long, digest binary, sketches array<struct<size_class:int,registers:binary>>"
)
_SIGNATURES_ARROW = pa.schema([
    ("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
    ("sketches", pa.list_(pa.struct([("size_class", pa.int32()), ("registers", pa.binary())]))),
])


def signatures(docs: DataFrame, id_column: str, text: str, shingle_words: int = SHINGLE_WORDS,
               least_percent: int = LEAST_PERCENT) -> DataFrame:
    """Per row: id, size and digest of its shingle set, registers for its size classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = shingle_set(data or b"", shingle_words)
                sketches = [
                    {"size_class": c, "registers": registers(found, c).tobytes()}
                    for c in (size_classes(len(found), least_percent) if len(found) else ())
                ]
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                rows.append((i, len(found), digest, sketches))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*rows), _SIGNATURES_ARROW)], schema=_SIGNATURES_ARROW)

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, SIGNATURES)


def _band_keys(sketch: Column) -> Column:
    """Array of one 64-bit key for each band of a sketch's registers."""
    width = 2 * BAND_REGISTERS
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, sketch["size_class"], F.substring(sketch["registers"], b * width + 1, F.lit(width))),
    )


# Verification -------------------------------------------------------------

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, least_percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Pairs of one b are dealt out in chunks, and each chunk gets b's text once:
    a text that many are compared with is neither repeated for each of them nor
    gathered in one task.
    """
    chunks = F.ceil(F.col("n") / CHUNK)
    dealt = (
        pairs.join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b")
        .select("a", "b", F.pmod(F.xxhash64("a"), chunks).alias("chunk"))
    )
    asked = dealt.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "chunk", F.lit(1).alias("member")).unionByName(
        dealt.select("b", "chunk").distinct().select(
            F.col("b").alias("id"), F.col("b").alias("pivot"), "chunk", F.lit(0).alias("member")))
    rows = texts.join(asked, "id").select("pivot", "chunk", "member", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            columns = [*(batch.column(k) for k in range(4)), batch.column(4).cast(pa.binary())]
            for own, chunk, member, i, text in zip(*(c.to_pylist() for c in columns)):
                hashes = shingle_set(text or b"", shingle_words)
                if not member:
                    pivot, base = (own, chunk), hashes
                elif pivot == (own, chunk):
                    if _alike(base, hashes, least_percent):
                        found.append((i, own))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], schema=_LINKS)

    return (
        rows.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "member")
        .mapInArrow(run, "a long, b long")
    )


def _estimated(pairs: DataFrame, reps: DataFrame, least_percent: int) -> DataFrame:
    """The pairs whose sizes and registers allow the similarity."""
    side = lambda x: reps.select(
        F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketches").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(
        100 * F.least("n_a", "n_b") >= least_percent * F.greatest("n_a", "n_b"))
    common = F.filter("s_a", lambda s: F.exists("s_b", lambda t: t["size_class"] == s["size_class"]))[0]
    columns = joined.withColumn("_s", common).where("_s is not null").select(
        "a", "b", F.col("_s.size_class").alias("size_class"), F.col("_s.registers").alias("r_a"),
        F.filter("s_b", lambda t: t["size_class"] == F.col("_s.size_class"))[0]["registers"].alias("r_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimate = Estimator(least_percent)
        for batch in batches:
            sides = [
                np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BUCKETS) for k in (3, 4)]
            keep = pa.array(estimate.similar(*sides, batch.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=_LINKS)

    return columns.mapInArrow(run, "a long, b long")


def _open_buckets(bands: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components so far, with the largest one."""
    labelled = bands.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    open_ = (
        sizes.groupBy("key")
        .agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"),
             F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("shingles").alias("shingles"))
        .where("parts > 1").drop("parts")
    )
    return labelled.join(open_, "key")


_CANDIDATES = pa.schema([
    ("key", pa.int64()), ("block", pa.int32()), ("side", pa.int32()), ("id", pa.int64()),
    ("others", pa.list_(pa.int64())), ("components", pa.list_(pa.int64())),
])


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip(zip(*rows), _CANDIDATES)], schema=_CANDIDATES)


def _across(rows: DataFrame, reps: DataFrame, texts: DataFrame, shingle_words: int, least_percent: int) -> DataFrame:
    """Links between different components of a bucket.

    Of each bucket the members outside its largest component meet all members.
    These are dealt out in blocks of bounded size and the few others are repeated
    for each block, so no bucket is gathered in one task. First registers are
    compared in the task: a row for each such member lists the members that it
    may be similar to, in the first band that they share. Then these meet with
    their texts, and each is verified against its list, the likeliest first,
    until it is linked with a component. So there are never more rows than
    members, however many pairs are looked at.
    """
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    common = ["key", "band", "id", "size_class", "component"]
    probes = rows.where("component <> major").select(
        *common, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("side"))
    dealt = probes.unionByName(rows.select(*common, "block", F.lit(1).alias("side")))
    registers_of = reps.select("id", "n_shingles", F.explode("sketches").alias("s")).select(
        "id", "n_shingles", F.col("s.size_class").alias("size_class"), F.col("s.registers").alias("registers"))
    full = dealt.join(registers_of, ["id", "size_class"]).select(
        "key", "block", "side", "id", "component", "n_shingles", "size_class", "registers", "band")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimate = Estimator(least_percent)
        for (key, block), group in _grouped(batches, 2):
            members, used, out = [], np.zeros(0, bool), []
            for side, i, component, n, size_class, sketch, band in group:
                own = np.frombuffer(sketch, "<u2")[None, :]
                if side:
                    members.append((i, component, n, own))
                    continue
                if not len(used):  # the first that looks for links; all members are there
                    ids, components, sizes = (np.array([m[k] for m in members]) for k in range(3))
                    sketches = np.concatenate([m[3] for m in members]) if members else None
                    used = np.zeros(max(1, len(members)), bool)
                if not members:
                    break
                near = 100 * np.minimum(n, sizes) >= least_percent * np.maximum(n, sizes)
                at = np.flatnonzero(near & (components != component))
                likely = estimate.share(own, sketches[at], np.array([size_class]))
                fit = (likely >= estimate.least) & ~_share_bands(own, sketches[at], band)
                at = at[fit][np.argsort(-likely[fit], kind="stable")]
                if len(at):
                    used[at] = True
                    out.append((key, block, 0, i, ids[at].tolist(), components[at].tolist()))
                if len(out) >= 1000:
                    yield _lists(out)
                    out = []
            out += [(key, block, 1, int(ids[k]), [], []) for k in np.flatnonzero(used)]
            if out:
                yield _lists(out)

    lists = written(
        # members come first, then those that look for links
        full.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("side"), "id")
        .mapInArrow(listed, "key long, block int, side int, id long, others array<long>, components array<long>"), "lists")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 2):
            sets, found = {}, []
            for side, i, others, components, text in group:
                own = shingle_set(text or b"", shingle_words)
                if side:
                    sets[i] = own
                    continue
                done = set()
                for other, component in zip(others, components):
                    if component not in done and other in sets and _alike(own, sets[other], least_percent):
                        done.add(component)
                        found.append((i, other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=_LINKS)

    return (
        lists.join(texts, "id").select("key", "block", "side", "id", "others", "components", F.col("text").cast("binary"))
        .repartition("key", "block").sortWithinPartitions("key", "block", F.desc("side"), "id")
        .mapInArrow(linked, "a long, b long")
    )


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first columns, as (key, rest of each row)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, group in groupby(rows, lambda r: r[:keys]):
        yield key, (r[keys:] for r in group)


def _alike(a: np.ndarray, b: np.ndarray, least_percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least_percent * (len(a) + len(b) - both)


def _share_bands(a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
    """Which rows of registers agree in one of the first ``number`` bands."""
    width = number * BAND_REGISTERS
    return (a[:, :width] == b[:, :width]).reshape(len(b), number, BAND_REGISTERS).all(axis=2).any(axis=1)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    shingle_words: int = SHINGLE_WORDS, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs.

    Two documents are linked if their sets of ``shingle_words``-word shingles
    share at least ``least_percent`` hundredths of their union. component_id is
    the smallest id reachable by links, kept marks the document that has it as
    its own id. Fewer words are one shingle. Null and empty texts have no
    shingle and link with nothing. Rows with a null id link with nothing, have
    no component and are kept. Repeated rows stay repeated; rows with one id and
    different texts are one node, whose links are those of one of the texts. An
    empty table gives no rows. ``least_percent`` is over 50.

    1. Rows become signatures; equal sets are one class from here on.
    2. The members of each band's bucket are paired with its center, the one
       that shares most buckets; estimated, verified on full sets, and joined
       into components.
    3. Where a bucket still holds several components, members outside its
       largest one are compared with all others, and verified.
    """
    if not 50 < least_percent <= 100:
        raise ValueError("least_percent must be over 50 and at most 100")
    signed = written(signatures(docs, id_column, text, shingle_words, least_percent), "signatures")
    with_set = signed.where("digest is not null and id is not null")
    reps = written(
        with_set.groupBy("digest").agg(
            F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketches").alias("sketches")),
        "classes")
    bands = reps.select("id", "n_shingles", F.explode("sketches").alias("s")).select(
        "id", "n_shingles", F.col("s.size_class").alias("size_class"), F.posexplode(_band_keys(F.col("s"))).alias("band", "key"))
    counts = bands.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = written(bands.join(counts, "key"), "buckets")
    # the text in the middle of a group shares buckets with most others
    shared = written(
        shared.join(shared.groupBy("id").agg(F.sum("rows").alias("shared")), "id").drop("rows"), "buckets")
    centers = shared.groupBy("key").agg(F.max(F.struct("shared", "id"))["id"].alias("center"))
    # only texts that share a bucket are needed, once for each class
    needed = written(
        docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
        .join(shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")

    tried = _estimated(
        shared.join(centers, "key").where("id <> center").select("id", "center").distinct()
        .select(F.col("id").alias("a"), F.col("center").alias("b")), reps, least_percent)
    links = written(_verified(tried, needed, shingle_words, least_percent), "links")
    rows = _open_buckets(shared, connected_components(links))
    links = links.unionByName(written(_across(rows, reps, needed, shingle_words, least_percent), "links"))
    copies = with_set.join(reps.select("digest", F.col("id").alias("rep")), "digest").where("id <> rep").select(
        F.col("id").alias("a"), F.col("rep").alias("b"))
    every = connected_components(links.unionByName(copies))
    return (
        signed.join(every, signed["id"] == every["node"], "left")
        .select(
            signed["id"].alias(id_column), "n_shingles",
            F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row for each group of near duplicates: that of the smallest id.

    Repeated rows of one id are a group too; rows without an id all stay, and so
    do rows of different ids without words.
    """
    found = near_duplicates(docs, id_column, text, **options)
    gone = found.where("not kept").select(id_column).distinct()
    left = docs.join(gone, id_column, "left_anti").withColumn(
        "_own_row", F.when(F.col(id_column).isNull(), F.monotonically_increasing_id()))
    return left.dropDuplicates([id_column, "_own_row"]).select(*docs.columns)
