"""Groups of notes that say the same: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash gives each word one random permutation of the signature's positions plus fractions;
a position holds the least rank at which any word of the text hits it. The ranks of one word are
correlated (each position once), which makes the estimate less noisy than independent minima, and
the walk over ranks stops as soon as no later rank can lower a position.

Rows with the same set of words are merged before anything is banded. In each bucket every member
is compared with the bucket's least id only; members that turn out unlike it are then compared
with the others of a small bucket. Crowded buckets whose members are unlike each other, as of notes
from one template, are not expanded: their members meet by their rarest words instead, which two linked
sets must share (prefix filtering), so no link is lost there either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.sources.storage import cut_lineage

#: Chance that a link at exactly 0.65 shares no band: (1 - 0.65^7)^112 = 0.4 %; at 0.70 0.007 %.
BANDS, ROWS = 112, 7
SIMILARITY = 0.65
#: Of 256 one-bit minima a pair at 0.65 agrees in 211 +- 6.1; fewer than this is five deviations away.
SKETCH_BITS, SKETCH_LEAST = 256, 180
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
WORD_TABLE = 16_384
#: Members of a bucket from which on those unlike its pivot meet by their rarest words.
CROWDED = 32
#: Parts of a hot bucket; also, one in so many texts is looked at to find these, of which so many must share the bucket.
SALTS, SAMPLED_OFTEN = 64, 8

WORD = re.compile(r"[^\W_]+")


def distinct_words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased, distinct and sorted."""
    return sorted(set(WORD.findall(text.lower()))) if text else []


class SuperMinHash:
    """Signatures of ``size`` positions; a table of word permutations is kept between texts."""

    def __init__(self, size: int):
        self.size = size
        self.row_of: dict[int, int] = {}
        self.places = np.empty((256, size), dtype=np.int16)
        self.fractions = np.empty((256, size), dtype=np.uint64)

    def _rows(self, words: np.ndarray) -> np.ndarray:
        if len(self.row_of) + len(words) > WORD_TABLE:
            self.row_of.clear()
        rows = np.empty(len(words), dtype=np.int64)
        for i, word in enumerate(words.tolist()):
            row = self.row_of.get(word)
            if row is None:
                row = len(self.row_of)
                if row >= len(self.places):
                    self.places = np.concatenate([self.places, np.empty_like(self.places)])
                    self.fractions = np.concatenate([self.fractions, np.empty_like(self.fractions)])
                draw = np.random.Generator(np.random.PCG64(word)).integers(0, 1 << 32, size=2 * self.size, dtype=np.uint64)
                self.places[row] = np.argsort(draw[: self.size], kind="stable")
                self.fractions[row] = draw[self.size :]
                self.row_of[word] = row
            rows[i] = row
        return rows

    def signature(self, words: np.ndarray) -> np.ndarray:
        """Least (rank << 32 | fraction) of each position over the words (64-bit hashes)."""
        if len(words) > WORD_TABLE // 2:
            return np.minimum.reduce([self.signature(part) for part in np.array_split(words, -(-len(words) * 2 // WORD_TABLE))])
        rows = self._rows(words)
        best = np.full(self.size, np.iinfo(np.uint64).max, dtype=np.uint64)
        step = max(1, min(self.size, -(-2 * self.size // len(words))))
        for rank in range(0, self.size, step):
            upto = min(rank + step, self.size)
            value = (np.arange(rank, upto, dtype=np.uint64) << np.uint64(32)) | self.fractions[rows, rank:upto]
            np.minimum.at(best, self.places[rows, rank:upto].ravel(), value.ravel())
            if int(best.max()) >> 32 < upto:  # early stop: every position is held by a lower rank
                break
        return best


def _hash_words(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, keys = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = distinct_words(text)
            if words:
                keep.append(i)
                keys.append(xxhash.xxh128_digest("\n".join(words).encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(keys, pa.binary())], names=["id", "key"])


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = SuperMinHash(bands * rows)
        salt = np.arange(bands, dtype=np.uint64)[:, None]
        for batch in batches:
            words_out, buckets, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                words = np.sort(_hash_words(distinct_words(text)))
                sig = maker.signature(words)
                grid = np.ascontiguousarray(np.concatenate([salt, sig.reshape(bands, rows)], axis=1))
                buckets.append([xxhash.xxh64_intdigest(line.tobytes()) for line in grid])
                sketches.append(np.packbits((sig[:SKETCH_BITS] & np.uint64(1)).astype(np.uint8)).view(np.int64))
                words_out.append(words.view(np.int64))
            bits = np.array(sketches, dtype=np.int64).reshape(len(sketches), len(SKETCH))
            hashed = [np.array(b, dtype=np.uint64).view(np.int64) for b in buckets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words_out, pa.list_(pa.int64())), pa.array(hashed, pa.list_(pa.int64())), *[pa.array(bits[:, i], pa.int64()) for i in range(len(SKETCH))]],
                names=["id", "words", "buckets", *SKETCH],
            )

    return run


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float, keep_unlike: bool = True) -> DataFrame:
    """(a, b, sim) of distinct candidate pairs; sim is null where the sketches already rule a link out.

    Without ``keep_unlike`` those pairs are left out, and words are fetched only for the few texts left.
    """
    sketch = texts.select("id", *SKETCH, F.size("words").alias("n"))
    side = lambda x: sketch.select(F.col("id").alias(x), F.array(*SKETCH).alias(f"{x}_bits"), F.col("n").alias(f"{x}_n"))
    differ = sum((F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(len(SKETCH))), F.lit(0))
    alike = (differ <= SKETCH_BITS - SKETCH_LEAST) & (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * similarity)
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", alike.alias("near"))
    near = cut_lineage(near if keep_unlike else near.where("near"))
    words = texts.select("id", "words")
    if not keep_unlike:
        words = words.join(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "id", "left_semi")
    exact = near.where("near").join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    exact = exact.select("a", "b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("sim"))
    return exact.unionByName(near.where("not near").select("a", "b", F.lit(None).cast("double").alias("sim")))


def _starred(texts: DataFrame, bands: int) -> DataFrame:
    """(bucket, id, pivot, n): members of the buckets of n > 1 texts with the least of their ids, which has no row.

    One exchange serves the counts and the members. Buckets that a 64th of the texts shows to hold more than
    a thousandth of all (and eight of that sample), so at most ``bands`` thousand, are spread over 64 parts.
    """
    banded = texts.select(F.explode("buckets").alias("bucket"), "id").where("bucket is not null and id is not null")
    often = max(SAMPLED_OFTEN, texts.count() // SALTS // 1000)
    sampled = texts.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(SALTS)) == 0).select(F.explode("buckets").alias("bucket"))
    hot = F.broadcast(cut_lineage(sampled.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") >= often).select("bucket", F.lit(True).alias("hot"))))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(-1).cast("int")
    salted = banded.join(hot, "bucket", "left").select("bucket", "id", salt.alias("salt")).where("salt is not null").repartition("bucket", "salt")
    parts = salted.groupBy("bucket", "salt").agg(F.min("id").alias("pivot"), F.count("*").alias("n"))
    spread = F.broadcast(parts.where("salt >= 0").groupBy("bucket").agg(F.min("pivot").alias("hot_pivot"), F.sum("n").alias("hot_n")))
    # no further filter on the keys here: it would move below the exchange, which could then not be shared
    joined = salted.join(parts.where("n > 1").hint("shuffle_hash"), ["bucket", "salt"], "left").join(spread, "bucket", "left")
    return joined.select("bucket", "id", F.coalesce("hot_pivot", "pivot").alias("pivot"), F.coalesce("hot_n", "n").alias("n")).where("id != pivot")


def near_duplicate_links(
    notes: DataFrame, id_col: str = "id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rep) name each note's representative, the least id with the
    same words; links (a, b, sim) are verified pairs of representatives, a < b, that connect every group.
    """
    source = notes.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").groupBy("id").agg(F.max("text").alias("text"))
    keyed = cut_lineage(source.mapInArrow(_keys, "id bigint, key binary"))
    reps = keyed.groupBy("key").agg(F.min("id").alias("rep"))
    members = keyed.join(reps, "key").select("id", "rep")
    chosen = source.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    texts = cut_lineage(chosen.select("id", "text").mapInArrow(_signatures(bands, rows), "id bigint, words array<bigint>, buckets array<bigint>, " + ", ".join(f"{x} bigint" for x in SKETCH)))

    starred = cut_lineage(_starred(texts, bands))
    star = _verify(starred.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), texts, similarity)
    star = cut_lineage(star)

    # Members unlike their pivot against the rest of a small bucket; 1 - sim is a metric, so two members
    # whose distances to the pivot differ by more than the limit cannot be linked.
    far = 1 - similarity
    wide = starred.where("n > 2").select("bucket", "pivot", "id", "n")
    unlike = star.where(F.col("sim").isNull() | (F.col("sim") < similarity)).toDF("pivot", "x", "sx")
    loose = cut_lineage(wide.withColumnRenamed("id", "x").join(unlike, ["pivot", "x"]).select("bucket", "x", "sx", "n"))
    few = loose.where(F.col("n") <= CROWDED).drop("n")
    around = wide.join(few.select("bucket").distinct(), "bucket", "left_semi").join(star.toDF("pivot", "id", "sim"), ["pivot", "id"])
    met = around.join(few, "bucket").where(F.col("id") != F.col("x")).where(F.col("sim").isNull() | F.col("sx").isNull() | (F.abs(F.col("sim") - F.col("sx")) <= far + 1e-9))
    met = met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))

    linked = star.where(F.col("sim") >= similarity - 1e-12)
    crowded = cut_lineage(loose.where(F.col("n") > CROWDED).select("bucket").distinct())
    if not crowded.isEmpty():
        members_of = starred.join(crowded, "bucket", "left_semi")
        hot = cut_lineage(members_of.select("id").unionByName(members_of.select(F.col("pivot").alias("id"))).distinct())
        known = linked.join(hot.withColumnRenamed("id", "a"), "a", "left_semi").join(hot.withColumnRenamed("id", "b"), "b", "left_semi")
        labels = connected_components(known, "a", "b").toDF("id", "label")
        labelled = cut_lineage(hot.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label")))  # written, so that the join knows its size
        met = met.unionByName(rare_word_pairs(texts.join(labelled, "id").select("id", "label", "words"), similarity))

    more = met.distinct().join(star.select("a", "b"), ["a", "b"], "left_anti")
    links = linked.unionByName(_verify(more, texts, similarity, keep_unlike=False).where(F.col("sim") >= similarity - 1e-12))
    return members, cut_lineage(links)


def rare_word_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: candidates that include every pair of different labels with at least this Jaccard similarity.

    Takes (id, label, words): distinct words of each, and a label of sets already known to belong together,
    which are not paired. Words are ordered by how many sets hold them. Sets x and y that share enough
    words must share one among the first ``|x| - a + 1`` of x and ``|y| - a + 1`` of y, where ``a`` is the
    overlap that their sizes ask for; sizes are taken in steps of a tenth. What a whole collection has in
    common comes last in that order and pairs nothing. Of a word's holders those of its commonest
    label are not paired among each other.
    """
    step = 1.1
    band = lambda n: F.floor(F.log(n) / float(np.log(step)) + 1e-9).cast("int")
    held = sets.select("id", "label", F.size("words").alias("n"), F.explode("words").alias("word"))
    order = F.sort_array(F.collect_list(F.struct("df", "word")))
    ordered = held.join(held.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("id", "label", "n").agg(order.alias("ordered"))
    reach = F.sequence(band(F.col("n") * similarity), band(F.col("n") / similarity))
    aimed = ordered.select("id", "label", "n", band(F.col("n")).alias("own"), F.explode(reach).alias("other"), "ordered")
    least = F.greatest(F.pow(F.lit(step), "other"), F.col("n") * similarity)
    need = F.ceil((F.col("n") + least) * (similarity / (1 + similarity)) - 1e-6)
    keyed = aimed.select("id", "label", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.explode(F.slice("ordered", F.lit(1), F.greatest(F.col("n") - need + 1, F.lit(0)).cast("int"))).alias("o"))
    key = ["word", "low", "high"]
    keyed = cut_lineage(keyed.select(F.col("o.word").alias("word"), "low", "high", "own", "id", "label"))
    main = keyed.groupBy(*key, "label").agg(F.count("*").alias("c")).groupBy(*key).agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    minor = keyed.join(main, key).where("label != main").select(*key, F.col("own").alias("xo"), F.col("id").alias("x"), F.col("label").alias("xl"))
    pairs = minor.join(keyed, key).where("xl != label and (xo != own or low = high)")
    return pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def near_duplicate_groups(notes: DataFrame, id_col: str = "id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, group_id): one row for each note that has a word.

    ``group_id`` is the least id of the notes connected by links of at least ``similarity`` (shared
    distinct words over all distinct words of both); a note alone has itself as group. Null,
    empty and wordless texts take no part, a repeated (id, text) row counts once (of several texts
    under one id the greatest in sort order counts), and further columns are not read.
    """
    members, links = near_duplicate_links(notes, id_col, text_col, similarity, bands, rows)
    groups = connected_components(links, "a", "b").toDF("rep", "component")
    return members.join(groups, "rep", "left").select("id", F.coalesce("component", "rep").alias("group_id"))


def same_group_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b) with id_a < id_b of rows that share a group_id: what a pair report asks for, and as long as
    the square of its largest group. ``near_duplicate_groups`` is the form for large groups.
    """
    left = groups.select("group_id", F.col("id").alias("id_a"))
    right = groups.select("group_id", F.col("id").alias("id_b"))
    return left.join(right, "group_id").where("id_a < id_b").select("id_a", "id_b")
