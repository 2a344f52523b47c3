"""SimHash near-duplicates: fingerprints of word shingles, linked by multi-index hashing over distinct fingerprints.

A fingerprint has two segments of 32 bits, and a table for each holds every distinct fingerprint by that segment. Two
fingerprints at a distance of 2 at most either agree in the second segment, or differ by one bit at most in the first
one. So a fingerprint looks up its own second segment, and the ball of radius 1 round its first one; of two neighbours in
a ball the one with the 0 bit looks the other up, so bits are only set. Matches are verified on the whole fingerprints.

A segment that more than COMMON distinct fingerprints share isn't looked up, as that would give all pairs of them.
Fingerprints with such a segment in reach enumerate the ball of radius 1 round the whole fingerprint instead, both sides
of a link alike: two at a distance of 2 at most meet under some of these keys, those that meet are within 2 of each
other, so a key has 65 fingerprints at most, and neighbours in its sorted list keep the list connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.llm.common import map_arrow, text_or_empty, written
from crawlsight.llm.components import components
from crawlsight.llm.line_dedup import LAST_ID

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Distinct fingerprints of one segment up to which they are looked up by it.
COMMON = 64
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def shingles(text: str, size: int = SHINGLE) -> Iterator[bytes]:
    """Space-joined runs of ``size`` words in UTF-8, repeats included; of fewer words the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; split at \x20 and \x09-\x0D
    if len(words) <= size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; zero for no words. As a signed 64-bit number."""
    digests = b"".join(xxhash.xxh64_digest(s, seed) for s in shingles(text, size))
    bits = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(bits), CHUNK):
        ones += np.unpackbits(bits[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big", signed=True)


def fingerprint_partition(batches, size: int, seed: int):
    for batch in batches:
        prints = [fingerprint(t, size, seed) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["doc_id", "tk", "fp"])


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, text): tk tells rows of one doc_id apart; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("tk"), "text")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, tk, fp) of each row of docs (doc_id, text)."""
    return map_arrow(identified(docs), fingerprint_partition, "doc_id long, tk long, fp long", size, seed)


#: Keys of both segments' tables: the first segment's bits, and the second one's with bit 32 set.
SEGMENTS = "array(shiftrightunsigned(fp, 32), (fp & 4294967295L) | 4294967296L)"
#: Of the first segment, all that differ by one bit which is set there and not here.
BALL = "transform(filter(sequence(0, 31), i -> (fp & shiftleft(1L, i + 32)) = 0), i -> shiftrightunsigned(fp, 32) | shiftleft(1L, i))"


def links(prints: DataFrame, common: int = COMMON) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp``, enough to connect all that are within DISTANCE bits."""
    tables = prints.select("fp", F.expr(f"explode({SEGMENTS})").alias("key"))
    probes = prints.select("fp", F.expr(f"posexplode(concat({SEGMENTS}, {BALL}))").alias("place", "key"))
    sizes = written(tables.groupBy("key").agg(F.count("*").alias("n")), "simhash-sizes")
    # A fingerprint's own segments (the first two keys) are looked up only where another one has them too.
    found = written(probes.join(sizes, "key").where("place > 1 OR n > 1").drop("place"), "simhash-probes")
    near = lambda a, b: (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE) & (F.col(a) != F.col(b))
    rare = found.where(F.col("n") <= common).select(F.col("fp").alias("a"), "key").join(tables.withColumnRenamed("fp", "b"), "key")
    crowded = found.where(F.col("n") > common).select("fp").distinct()
    keys = crowded.select("fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))").alias("key"))
    before = F.lag("fp").over(Window.partitionBy("key").orderBy("fp"))
    met = keys.select(before.alias("a"), F.col("fp").alias("b"))
    return rare.where(near("a", "b")).select("a", "b").union(met.where(near("a", "b")))


def classified(docs: DataFrame, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """prints (doc_id, tk, fp) of all rows, and for each distinct fp the root that stands for its component."""
    prints = written(fingerprints(docs, size, seed), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp")), "simhash").withColumnRenamed("node", "fp")
    return prints, written(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-rooted")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over links of 2 bits at most) for each row of docs (doc_id, text).

    A null or blank text has the fingerprint zero, linked like any other. A row with a null doc_id keeps it and is
    linked; component_id is null only where a component has no other. Repeated rows are returned as often as they come.
    Other columns are ignored; an empty table gives no rows.
    """
    prints, rooted = classified(docs, size, seed)
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    classes = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of docs, with its columns, for each component: that of the least doc_id, a null after all others.

    Of several texts of that doc_id one is taken by a hash, of repeated rows any. Cases are those of near_duplicates().
    """
    prints, rooted = classified(docs, size, seed)
    place = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("did"), "tk")
    first = prints.select("fp", place.alias("place")).groupBy("fp").agg(F.min("place").alias("place"))
    kept = rooted.join(first, "fp").groupBy("root").agg(F.min("place").alias("place"))
    kept = written(kept.select("place.did", "place.tk"), "simhash-kept")
    return rows_at(docs, kept)


def rows_at(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of docs for each place of kept (did, tk); did is the doc_id, LAST_ID for a null."""
    did, row = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(did.alias("did"), F.xxhash64(text_or_empty()).alias("tk"), row.alias("row"))
    return rows.join(kept, ["did", "tk"], "left_semi").groupBy("did", "tk").agg(F.first("row").alias("row")).select("row.*")


def hex_digits(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
