"""Near-duplicate documents: MinHash bands for candidates, odd sketches to sift them, full sets to decide.

Plan.
1. One pass turns a text into its set of word shingles (64-bit hashes), MinHash samples, band keys and an
   odd sketch: each sample flips one bit of a bitmap, so that the XOR of two bitmaps has one bit for about
   every sample that differs, which is precise where similarity is high. Documents with equal sets form a
   class at once, represented by the smallest id.
2. In each bucket of a band, members are compared with the bucket's smallest id only (a star).
   Pairs whose sizes or sketches rule the threshold out go; the others are decided on full sets.
3. Only documents of buckets in which the links found so far leave several components are looked at again. They
   get longer sketches and longer bands (FINE), whose buckets are stars again: members outside the component of the
   bucket's smallest id are compared with it.
4. What is left are long buckets that still hold several components. Members of different components are paired,
   each pair once, where a bucket has at most FEW of them. Those of larger buckets are paired where they share
   one of their rarest shingles, which is exact (see `_rare_pairs`). So a bucket of thousands of copies, or of texts
   that share a template but too little else, costs work in proportion to its size.
5. Components of the links give each document the smallest id that it can reach.

A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands: at 0.75, with 50 bands of 5
rows, all but 1 in 750,000; with 200 bands of 10, all but 1 in 100,000. Sifts admit what a sketch puts up to `slack` below the threshold: SLACK is over four
standard deviations of either sketch.

Defined cases: a text without words, or a null one, has an empty set and is linked with nothing; one with
fewer words than a shingle has its whole sequence as its only shingle; repeated rows are copies of each
other; rows of one id with different texts count as linked; a null id is linked with nothing, has a null
component and is kept; other columns are ignored by `link`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import bound_batches, discard, materialize, mix, powers, span_hashes, steps, utf8, window_hashes, word_bounds

BANDS, ROWS, BITS = 50, 5, 1024
#: Bands, rows and bits of the longer sketch.
FINE = (200, 10, 8192)
#: For the first sketch and the longer one.
SLACK = (0.2, 0.05)
#: Members of a star that one task compares with their centre before the next portion starts.
PORTION = 64
#: Members of a long bucket with several components up to which they are paired as they are.
FEW = 8
#: Words of 64 bits in a set's bitmap.
BITMAP = 16
_BITMAP = [f"m{i}" for i in range(BITMAP)]
#: Classes of shingles, by remainder, each with its smallest one among a set's rarest: equal ones tell at which shingle two sets meet.
MEETINGS = 16
_LEAST = [f"l{i}" for i in range(MEETINGS)]
#: Ids up to which they are sent to every task in place of a shuffle of all texts: some 24 MB.
SENT_IDS = 1 << 20
#: Numbers in a temporary array of a sampler: 1 to 4 MB.
_ARRAY = 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Of each row: the sorted distinct 64-bit hashes of its runs of `words` words, A-Z as a-z."""
    starts, ends, first = word_bounds(data, offsets)
    each = span_hashes(data, starts, ends, fold=True, twice=True)
    runs = window_hashes(each, words)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.sum(each[a:b] * powers(0x9E3779B97F4A7C15, words)[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Sampler:
    """MinHash samples, band keys and odd sketches from sets of 64-bit hashes, in portions: temporary arrays have about _ARRAY numbers."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = BITS):
        self.bands, self.rows, self.bits = bands, rows, bits
        n = np.arange(1, bands * rows + 1, dtype=np.uint64)
        self.multipliers = (mix(n * np.uint64(0x632BE59BD9B4E019)).astype(np.uint32) | np.uint32(1))[:, None]
        self.weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.salts = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))
        self.places = mix(n << np.uint64(32))

    def samples(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(sets), self.bands * self.rows), 2**32 - 1, np.uint32)
        block = max(1, _ARRAY // out.shape[1])
        for row, s in zip(out, sets, strict=True):
            x = (s >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(x), block):
                np.minimum(row, (x[None, at : at + block] * self.multipliers).min(axis=1), out=row)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        out = np.empty((len(samples), self.bands), np.int64)
        for rows in self._portions(samples):
            cubes = samples[rows].astype(np.uint64).reshape(-1, self.bands, self.rows)
            out[rows] = mix((cubes * self.weights).sum(axis=2) + self.salts).view(np.int64)
        return out

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        out = np.empty((len(samples), self.bits // 64), np.int64)
        for rows in self._portions(samples):
            place = (mix(samples[rows].astype(np.uint64) + self.places) % np.uint64(self.bits)).astype(np.int64)
            place += np.arange(len(place))[:, None] * self.bits
            odd = np.bincount(place.ravel(), minlength=len(place) * self.bits).reshape(len(place), self.bits) & 1
            out[rows] = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
        return out

    def _portions(self, samples: np.ndarray) -> Iterator[slice]:
        step = max(1, _ARRAY // max(self.bits, self.bands * self.rows))
        return (slice(at, at + step) for at in range(0, len(samples), step))


def _profiles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                samples = sampler.samples(sets)
                keys, sketches = sampler.keys(samples), sampler.sketches(samples)
                sums = np.array([[x.sum(), np.bitwise_xor.reduce(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)))] if len(x) else [0, 0] for x in sets], np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                    _lists(keys), _lists(sketches),
                ], names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))


def _confirm(words: int, percent: int):
    """Rows arrive by centre and portion, the centre's text first: compares each member with it on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centres = None, []
        for batch in batches:
            group = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            data, offsets = utf8(batch.column(4))
            a_, b_ = [], []
            for a, b in steps(offsets):
                for (c, portion, member, i), s in zip(group[a:b], shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words), strict=True):
                    if (c, portion) != now:
                        now, centres = (c, portion), []
                    if not member:
                        if not any(np.array_equal(s, x) for x in centres):
                            centres.append(s)
                        continue
                    for x in centres:
                        both = len(np.intersect1d(s, x, assume_unique=True))
                        if 100 * both >= percent * (len(s) + len(x) - both) and both:
                            a_.append(c)
                            b_.append(i)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with one of the ids, written. Few ids are sent to the tasks, so that no other text moves; more are joined by a shuffle."""
    ids = materialize(ids.distinct(), "ids")
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    out = materialize(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "texts")
    discard(ids)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of written pairs (a, b, portion) those whose full sets reach the threshold. A centre's text goes once to each portion of its members."""
    wanted = pairs.select("a", "portion", F.lit(1).alias("member"), F.col("b").alias("id"))
    wanted = wanted.union(pairs.select("a", "portion", F.lit(0).alias("member"), F.col("a").alias("id")).distinct())
    rows = wanted.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("a", "portion", "member", "id", "text")
    return rows.repartition("a", "portion").sortWithinPartitions("a", "portion", "member").mapInArrow(_confirm(words, percent), "a long, b long")


def _fine(words: int):
    """(doc_id, component, text) to the longer sketch and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(*FINE)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in steps(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                samples = sampler.samples(sets)
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), _lists(sampler.keys(samples)), _lists(sampler.sketches(samples))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "component", "n_shingles", "bands", "sketch"])

    return run


def _shingles(words: int):
    """(doc_id, component, text) to its set of shingles and its bitmap: bit x % (64 * BITMAP) is set where the set holds x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in steps(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                n = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets)
                bits = np.zeros((len(sets), 64 * BITMAP), np.uint8)
                bits[np.repeat(np.arange(len(sets)), n), (flat % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
                bitmap = np.packbits(bits, axis=1).view(np.int64)
                shingles = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(flat.view(np.int64)))
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), shingles, *(pa.array(np.ascontiguousarray(c)) for c in bitmap.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "component", "n_shingles", "shingles", *_BITMAP])

    return run


def _sift(pairs: DataFrame, percent: int, slack: float, samples: int, bits: int) -> DataFrame:
    """Drops pairs that sizes exclude for certain, or odd sketches put more than slack below the threshold. pairs has n and sketch of both sides."""
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # u flips leave bits/2 * (1 - exp(-2u/bits)) bits set; two samples that differ are two flips
    apart = 2 * samples * (1 - percent / 100 + slack)
    most = bits / 2 * (1 - 2.718281828459045 ** (-2 * apart / bits))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.filter(sizes).filter(differ <= most)


def _sifted(pairs: DataFrame, profiles: DataFrame, percent: int, slack: float, samples: int, bits: int) -> DataFrame:
    """Of written pairs (a, b, n) those that sizes and sketches admit, dealt to portions: (a, b, portion)."""
    for side in "ab":
        pairs = pairs.join(profiles.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    portion = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PORTION)).alias("portion")
    return materialize(_sift(pairs, percent, slack, samples, bits).select("a", "b", portion).distinct(), "sifted")


def _stars(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of buckets that hold several classes: bucket, a (the bucket's smallest id), b; pairs of a bucket's smallest id and another member: a, b, n (an upper bound is the bucket's size))."""
    keyed = classes.select("doc_id", F.explode("bands").alias("bucket"))
    stars = materialize(keyed.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("other"), F.count("*").alias("n")).filter("a <> other").drop("other"), "stars")
    members = materialize(keyed.join(stars, "bucket").select("bucket", "a", F.col("doc_id").alias("b"), "n"), "members")
    return members, materialize(members.filter("a <> b").groupBy("a", "b").agg(F.max("n").alias("n")), "pairs")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (bucket, doc_id) of the buckets in which the links found leave several components, each with its component and n, the bucket's size."""
    placed = members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x <> y").select("bucket", "n")
    mixed = materialize(mixed, "buckets")
    out = materialize(placed.join(mixed, "bucket"), "mixed")
    discard(placed, mixed)
    return out


def _long_stars(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of long buckets with several components: (members: bucket, doc_id; pairs of the smallest id and a member of another component: a, b, n)."""
    keyed = long.select("doc_id", "component", F.explode("bands").alias("bucket"))
    home = F.min(F.struct("doc_id", "component")).alias("home")
    stars = materialize(keyed.groupBy("bucket").agg(home, F.max("component").alias("y"), F.min("component").alias("x"), F.count("*").alias("n")).filter("x <> y").select("bucket", "home", "n"), "stars")
    members = materialize(keyed.join(stars, "bucket"), "members")
    pairs = members.filter("component <> home.component").groupBy(F.col("home.doc_id").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n").alias("n"))
    pairs = materialize(pairs, "pairs")
    discard(stars)
    return members, pairs


def _rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n) of sets(row, doc_id, component, n_shingles, shingles, bitmap) in different components that share one of their rarest shingles and may reach the threshold.

    Two sets that reach the threshold have a shingle in common even among the floor((100 - percent) * size / 100) + 1
    that stand first in any order of all shingles. Ordered by how many of the documents hold them, shingles that a
    template spreads stand last, so that texts which share nothing else meet nowhere. Two bounds, exact as well, are
    part of the join: only shingles that several components hold can be common to two components, and each bit that
    one bitmap has and the other lacks is a shingle that is not common.

    Two sets of one family share most of their rarest shingles, but need to meet once. Where the smallest shingles of a
    class are equal on both sides, that shingle is common, so they meet at the first such one only; sets without any
    share few, and meet at each. What stays are the pairs that the bounds admit, about one row each; their number is the
    data's: a family whose texts all lie just below the threshold of each other has as many as its size squared.
    """
    tokens = sets.select("row", F.col("component").alias("c"), "n_shingles", F.explode("shingles").alias("token"))
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("held"), F.min("c").alias("x"), F.max("c").alias("y")).filter("held > 1"), "shared")
    own = Window.partitionBy("row")
    # shingles that no other document holds stand before all these
    rank = F.row_number().over(own.orderBy("held", "token")) + F.col("n_shingles") - F.count("*").over(own)
    first = tokens.join(shared, "token").withColumn("rank", rank).withColumn("common", F.count(F.when(F.col("x") != F.col("y"), 1)).over(own))
    first = first.filter(f"x <> y and 100 * common >= {percent} * n_shingles and rank <= (({100 - percent} * n_shingles) div 100) + 1")
    first = first.select("token", "row", "common", *(F.min(F.when(F.pmod("token", F.lit(MEETINGS)) == i, F.col("token"))).over(own).alias(c) for i, c in enumerate(_LEAST)))
    first = materialize(first.join(sets.drop("shingles"), "row").drop("row"), "prefixes")
    groups = first.groupBy("token").agg(F.min("component").alias("home"), F.max("component").alias("last"), F.count("*").alias("n")).filter("home <> last").drop("last")
    groups = materialize(groups, "tokens")
    strays = materialize(first.join(groups, "token").filter("component <> home").drop("home"), "strays")
    out = materialize(_across(strays, first, "token", percent, bounds=True), "rare")
    discard(shared, first, groups, strays)
    return out


def _met(left: DataFrame, right: DataFrame, key: str, percent: int, bounds: bool = False) -> DataFrame:
    """The rows of `_across` before repeats are dropped."""
    other = {"doc_id": "other", "component": "component_b", "n_shingles": "n_b", "common": "common_b"} | {m: f"{m}_b" for m in (*_BITMAP, *_LEAST)}
    right = right.select(key, *(F.col(c).alias(n) for c, n in other.items() if c in right.columns))
    met = left.join(right, key).filter("component > component_b").filter(f"100 * least(n_shingles, n_b) >= {percent} * greatest(n_shingles, n_b)")
    if bounds:
        alone = " + ".join(f"bit_count({m} & ~{m}_b)" for m in _BITMAP)
        alone_b = " + ".join(f"bit_count({m}_b & ~{m})" for m in _BITMAP)
        enough = f"{100 + percent} * {{}} >= {percent} * (n_shingles + n_b)".format
        met = met.filter(f"coalesce({', '.join(f'if({c} = {c}_b, {c}, null)' for c in _LEAST)}, {key}) = {key}")
        met = met.filter(enough("least(common, common_b)")).filter(enough(f"(n_shingles - ({alone}))")).filter(enough(f"(n_b - ({alone_b}))"))
    return met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"), "n")


def _across(left: DataFrame, right: DataFrame, key: str, percent: int, bounds: bool = False) -> DataFrame:
    """Pairs (a, b, n), each once, of rows of one key in different components whose sizes, and bounds on what they have in common, admit the threshold.

    left holds at least each key's rows outside its smallest component, right all: a pair is made from the side of the larger component.
    """
    return _met(left, right, key, percent, bounds).groupBy("a", "b").agg(F.max("n").alias("n"))


def _rest(members: DataFrame, long: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b, n) of members of mixed long buckets in different components."""
    few = materialize(members.filter(F.col("n") <= FEW).join(long.select("doc_id", "n_shingles").distinct(), "doc_id"), "few")
    pairs = _across(few, few, "bucket", percent)
    many = materialize(members.filter(F.col("n") > FEW).select("doc_id", "component").distinct(), "many")
    schema = "doc_id long, component long, n_shingles long, shingles array<long>, " + ", ".join(f"{m} long" for m in _BITMAP)
    sets = many.join(texts, "doc_id").select("doc_id", "component", "text").mapInArrow(_shingles(words), schema)
    sets = materialize(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    rare = _rare_pairs(sets, percent)
    out = materialize(pairs.unionByName(rare).groupBy("a", "b").agg(F.max("n").alias("n")), "rest")
    discard(few, many, sets, rare)
    return out


def link(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept (it is its component's smallest id)."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = materialize(docs.mapInArrow(_profiles(words), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"), "profiles")
    sets = profiles.filter("n_shingles > 0 and doc_id is not null")
    docs = docs.filter("doc_id is not null and text is not null")
    rep = F.min_by(F.struct("doc_id", "bands", "sketch"), "doc_id").alias("rep")
    classes = materialize(sets.groupBy("k1", "k2", "n_shingles").agg(rep).select("k1", "k2", "n_shingles", "rep.*"), "classes")

    members, pairs = _stars(classes)
    texts = _texts(docs, members.select(F.col("b").alias("doc_id")))
    sifted = _sifted(pairs, classes, percent, SLACK[0], BANDS * ROWS, BITS)
    links = materialize(_verified(sifted, texts, words, percent), "links")
    done = [members, pairs, sifted, texts]
    found = components(links)
    scattered = _mixed(members.select("bucket", F.col("b").alias("doc_id")), found)
    done += [found, scattered]
    if not scattered.isEmpty():
        long = scattered.select("doc_id", "component").distinct().join(texts, "doc_id").select("doc_id", "component", "text")
        long = materialize(long.mapInArrow(_fine(words), "doc_id long, component long, n_shingles long, bands array<long>, sketch array<long>"), "long")
        members, pairs = _long_stars(long)
        sifted = _sifted(pairs, long, percent, SLACK[1], FINE[0] * FINE[1], FINE[2])
        more = materialize(links.union(_verified(sifted, texts, words, percent)), "links")
        done += [long, members, pairs, sifted, links]
        found = components(more)
        mixed = _mixed(members.select("bucket", "doc_id"), found)
        done += [found, mixed]
        links = more
        if not mixed.isEmpty():
            rest = _rest(mixed, long, texts, words, percent)
            sifted = _sifted(rest, long, percent, SLACK[1], FINE[0] * FINE[1], FINE[2])
            links = materialize(more.union(_verified(sifted, texts, words, percent)), "links")
            done += [rest, sifted, more]

    twice = materialize(sets.groupBy("doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x <> y").select("doc_id"), "twice")
    same = sets.join(twice, "doc_id", "left_semi").join(classes.withColumnRenamed("doc_id", "rep"), ["k1", "k2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.union(same))
    named = classes.select("k1", "k2", "n_shingles", "doc_id").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    out = profiles.select("doc_id", "n_shingles", "k1", "k2").join(materialize(named, "named"), ["k1", "k2", "n_shingles"], "left")
    discard(*done, links, twice, final, classes)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, F.col("doc_id").eqNullSafe(component).alias("kept"))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
