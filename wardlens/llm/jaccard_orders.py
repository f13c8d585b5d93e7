"""Jaccard join of five-word shingle sets under several global token orders (operator 7).

For a similarity of t, two sets of which one has n tokens can differ in at most
d = n - ceil(t n) of them. So in any order of all tokens they share one of their first d + 1,
and of any s tokens of the set at least s - d are shared. Candidates pass three orders:

* Order by hash. Of the tokens below a fixed hash value (0.3 of all), a set with s of them
  needs s - d that some other set has too. One shuffle of these tokens leaves only sets that
  may have a partner.
* Order by document frequency, rarest first, counted over all tokens of the remaining sets.
  Tokens no other set has come first and cannot be shared; what is left of the prefix makes
  the posting lists. Frequent tokens only enter sets that consist of them almost wholly.
* Two more hash orders: the prefixes of a pair must meet under both, before its sets are
  intersected exactly.

Equal sets are one class, represented by its smallest document. Of each list, the set with the
fewest tokens of its own meets all others first, so a group around one original becomes one
component with as many pairs as members. Then lists are worked off from few to many leaders: a
document's level is drawn by hash (one in 16 per level); in the round of
level k, leaders of level k meet the list members of at most that level in other components.
Every pair of a list belongs to one round, so no link between components is lost, but the
members of a large group are linked through its first leaders and their other pairs are never
made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm import arrays
from wardlens.llm.anchors import _by_bucket, pack, unpack_ids
from wardlens.llm.components import components
from wardlens.llm.tables import materialize, unique_documents, without

SAMPLE = 0.3
FANOUT = 16
PACKED = "bucket long, kind int, n long, data binary, ids binary, starts binary, counts binary, sizes binary"
_SEEDS = (np.uint64(0x51ED270B2D9C1F4B), np.uint64(0xA24BAED4963EE407))
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in PACKED.split(", "))])


class Sets:
    """Sorted shingle sets of a block of texts: tokens of row r are tokens[bounds[r]:bounds[r + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int) -> None:
        data = arrays.lower_ascii(data)
        starts, ends, rows = arrays.words(data, offsets)
        n_rows = len(offsets) - 1
        hashes = arrays.span_hashes(data, starts, ends)
        runs = arrays.grams(hashes, size)
        inside = rows[: len(runs)] == rows[size - 1 :] if len(runs) else np.zeros(0, bool)
        token, row = runs[inside], rows[: len(runs)][inside]
        number = np.bincount(rows, minlength=n_rows)
        short = np.flatnonzero((number > 0) & (number < size))
        if len(short):
            first = np.searchsorted(rows, short)
            whole = [arrays.grams(hashes[a : a + n], int(n))[0] for a, n in zip(first, number[short], strict=True)]
            token = np.concatenate([token, arrays.mix(np.array(whole, np.uint64) ^ number[short].astype(np.uint64))])
            row = np.concatenate([row, short])
        order = np.argsort(token)
        order = order[np.argsort(row[order].astype(np.uint16) if n_rows < 1 << 16 else row[order], kind="stable")]
        token, row = token[order], row[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        self.tokens, self.rows = token[new], row[new]
        self.bounds = np.searchsorted(self.rows, np.arange(n_rows + 1))

    def sizes(self) -> np.ndarray:
        """Number of tokens per row."""
        return np.diff(self.bounds)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per token over each row, modulo 2**64."""
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def slack(n, percent: int):
    """How many of n tokens a partner may lack."""
    return n - (percent * n + 99) // 100


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, Sets]]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = arrays.buffers(batch.column(1))
        for a, b in arrays.blocks(offsets):
            yield ids[a:b], Sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)


def _emit(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _split(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit rest of mixed tokens; unequal tokens may meet, which only weakens a filter."""
    mixed = arrays.mix(tokens)
    return (mixed % np.uint64(buckets)).astype(np.int64), (mixed >> np.uint64(32)).astype(np.uint32)


def _sample(size: int, buckets: int):
    """Per document its set's size and signature (kind 9), and its tokens of the sample (kind 0).

    Of equal sets in a block only the first sends tokens.
    """
    limit = np.uint64(int(SAMPLE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _blocks(batches, size):
            low = sets.tokens < limit
            signs = [sets.sums(arrays.mix(sets.tokens ^ seed)) for seed in _SEEDS]
            n, s = sets.sizes(), sets.sums(low.astype(np.int64))
            body = np.stack([signs[0], signs[1]]).tobytes()
            rows = [pack(int(ids[0]) % buckets, 9, body, ids, n, s, [])]
            _, first = np.unique(signs[0], return_index=True)
            speaks = np.zeros(len(ids), bool)
            speaks[first] = True
            use = low & speaks[sets.rows]
            bucket, rest = _split(sets.tokens[use], buckets)
            owner = ids[sets.rows[use]]
            for b, part in _by_bucket(bucket):
                rows.append(pack(b, 0, rest[part].tobytes(), owner[part], [], [], []))
            yield from _emit(rows)

    return run


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order and, in it, how often each token occurs."""
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    cut = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(order)]])
    sizes = np.diff(cut) if len(order) else np.zeros(0, np.int64)
    return order, np.repeat(sizes, sizes)


_INFO = "doc_id long, n long, s long, sign_a long, sign_b long, shared long"


def _count_shared(table: pa.Table) -> pa.Table:
    """Document facts as they come, and per document how many tokens of this bucket another set has."""
    facts, tokens, owners = [], [], []
    for row in table.to_pylist():
        ids = unpack_ids(row["ids"], row["n"])
        if row["kind"] == 9:
            signs = np.frombuffer(row["data"], np.int64).reshape(2, -1)
            n, s = (np.frombuffer(row[k], np.int32).astype(np.int64) for k in ("starts", "counts"))
            facts.append((ids, n, s, signs[0], signs[1], np.full(len(ids), -1)))
        else:
            tokens.append(np.frombuffer(row["data"], np.uint32))
            owners.append(ids)
    if tokens:
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        order, times = _runs(tokens)
        ids, counts = np.unique(owners[order][times > 1], return_counts=True)
        zero = np.zeros(len(ids), np.int64)
        facts.append((ids, zero, zero, zero, zero, counts.astype(np.int64)))
    columns = [np.concatenate(x) for x in zip(*facts, strict=True)]
    return pa.table(dict(zip([x.split()[0] for x in _INFO.split(", ")], columns, strict=True)))


def _all_tokens(size: int, buckets: int):
    """All tokens of the remaining sets, with their place in hash order and the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _blocks(batches, size):
            bucket, rest = _split(sets.tokens, buckets)
            place = np.arange(len(sets.tokens)) - sets.bounds[sets.rows]
            n = sets.sizes()[sets.rows]
            rows = []
            for b, part in _by_bucket(bucket):
                rows.append(pack(b, 0, rest[part].tobytes(), ids[sets.rows[part]], place[part], n[part], []))
            yield from _emit(rows)

    return run


def _frequencies(buckets: int):
    """Tokens that several sets have, with their frequency, sent back to the documents."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [
            (np.frombuffer(r["data"], np.uint32), unpack_ids(r["ids"], r["n"]), np.frombuffer(r["starts"], np.int32), np.frombuffer(r["counts"], np.int32))
            for r in table.select(["n", "data", "ids", "starts", "counts"]).to_pylist()
        ]
        tokens, ids, places, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, times = _runs(tokens)
        order, times = order[times > 1], times[times > 1]
        tokens, ids, places, n = tokens[order], ids[order], places[order], n[order]
        rows = []
        for b, part in _by_bucket((arrays.mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
            part = part[np.argsort(ids[part], kind="stable")]
            body = tokens[part].tobytes() + n[part].astype(np.int32).tobytes()
            rows.append(pack(b, bucket, body, ids[part], places[part], times[part], []))
        return pa.Table.from_pylist(rows, _SCHEMA)

    return run


PARITY = 4
_POSTING = "token long, doc_id long, n long, s long, " + ", ".join(f"p{k} long" for k in range(PARITY))
_FACTS = ["n", "s", *(f"p{k}" for k in range(PARITY))]


def _prefixes(percent: int):
    """Postings of each document's prefix in order of frequency, then hash, with the set's size ``n``,
    the number ``s`` of its tokens that any other set has, and the parities of these in 256 classes."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for r in table.to_pylist():
            both = np.frombuffer(r["data"], np.uint32).reshape(2, -1)
            token = both[0].astype(np.int64) | (np.int64(r["kind"]) << np.int64(32))
            ids = unpack_ids(r["ids"], r["n"])
            parts.append((token, ids, both[1].astype(np.int64), np.frombuffer(r["starts"], np.int32), np.frombuffer(r["counts"], np.int32)))
        token, ids, n, place, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, times, ids))
        token, ids, n = token[order], ids[order], n[order]
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([first, [len(ids)]]))
        rank = np.arange(len(ids)) - np.repeat(first, sizes)
        alone = n - np.repeat(sizes, sizes)  # tokens of the set that no other set has come first
        use = rank < slack(n, percent) + 1 - alone
        columns = {"token": token[use], "doc_id": ids[use], "n": n[use], "s": np.repeat(sizes, sizes)[use].astype(np.int64)}
        place = arrays.mix(token.astype(np.uint64)) % np.uint64(64 * PARITY)
        bit = np.uint64(1) << (place % np.uint64(64))
        for k in range(PARITY):
            words = np.bitwise_xor.reduceat(np.where(place // np.uint64(64) == k, bit, np.uint64(0)), first)
            columns[f"p{k}"] = np.repeat(words, sizes)[use].astype(np.int64)
        return pa.table(columns)

    return run


def _verify(size: int, percent: int):
    """Pairs whose prefixes meet under two more hash orders and whose sets are similar enough."""

    def prefix(tokens: np.ndarray, seed: np.uint64) -> np.ndarray:
        keys = arrays.mix(tokens ^ seed)
        p = slack(len(keys), percent) + 1
        return keys if p >= len(keys) else np.partition(keys, p - 1)[:p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            keep = np.zeros(len(a), bool)
            data, offsets = arrays.buffers(batch.column(3))
            for low, high in arrays.blocks(offsets):
                sets = Sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
                for row in range(low, high):
                    if last is None or last != a[row]:
                        body = np.frombuffer(batch.column(2)[row].as_py(), np.uint8)
                        own = Sets(body, np.array([0, len(body)]), size).tokens
                        last, mine = a[row], (own, [prefix(own, seed) for seed in _SEEDS])
                    other = sets.tokens[sets.bounds[row - low] : sets.bounds[row - low + 1]]
                    if not all(
                        len(np.intersect1d(p, prefix(other, seed))) for p, seed in zip(mine[1], _SEEDS, strict=True)
                    ):
                        continue
                    common = len(np.intersect1d(mine[0], other, assume_unique=True))
                    keep[row] = 100 * common >= percent * (len(mine[0]) + len(other) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _may_link(percent: int):
    """Whether two sets may be similar: their tokens of their own, and one token at least for each class whose
    parity differs, lie in one set only, and may be no more than the similarity allows."""
    both = F.col("n_a") + F.col("n_b")
    apart = both - F.col("s_a") - F.col("s_b")
    for k in range(PARITY):
        apart = apart + F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b")))
    m = F.least("s_a", "s_b")
    return (100 * m >= percent * (both - m)) & ((100 + percent) * apart <= (100 - percent) * both)


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(
        "token", F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in (*_FACTS, "component", "level"))
    )


def _linked(texts: DataFrame, postings: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, component`` over the representatives, round by round from few leaders to all."""
    longest = postings.groupBy("token").count().agg(F.max("count")).first()[0] or 0
    top = 0
    while FANOUT ** (top + 1) <= longest:
        top += 1
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(FANOUT**top))
    level = F.lit(0)
    for k in range(1, top + 1):
        level = F.when(draw < FANOUT ** (top - k), k).otherwise(level)
    postings = materialize(postings.withColumn("level", level.cast("int")), "postings")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
        with_b = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
        both = with_b.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
        both = both.select("a", "b", "text_a", "text_b")
        return materialize(both.mapInArrow(_verify(size, percent), "a long, b long"), "links")

    own = postings.withColumn("component", F.col("doc_id"))
    centre = F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "doc_id", *_FACTS, "component", "level"))
    centres = _side(own.groupBy("token").agg(centre.alias("c")).select("token", "c.*"), "a")
    links = checked(centres.join(_side(own, "b"), "token").where((F.col("a") != F.col("b")) & _may_link(percent)))
    for k in range(top, -1, -1):
        labels = components(links)
        rows = postings.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        rows = rows.withColumn("component", F.coalesce("component", "doc_id"))
        lead, rest = _side(rows.where(F.col("level") == k), "a"), _side(rows.where(F.col("level") <= k), "b")
        once = (F.col("level_b") < k) | (F.col("a") < F.col("b"))
        apart = F.col("component_a") != F.col("component_b")
        pairs = lead.join(rest, (lead["token"] == rest["token"]) & apart & once & _may_link(percent))
        links = links.unionByName(checked(pairs))
    return components(links)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document.

    A null text, or one without words, has an empty set and is linked with nothing; one with
    fewer words than ``size`` has its whole sequence as one shingle. Rows with equal ids count as
    one document with the greatest of their texts; rows without an id are returned with their
    set's size and no component. Other columns are not read; an empty table gives an empty one.
    """
    known, nameless = unique_documents(docs, id_col, text_col)
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    binary = lambda df: df.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    packed = binary(known).mapInArrow(_sample(size, buckets), PACKED)
    info = materialize(packed.groupBy("bucket").applyInArrow(_count_shared, _INFO), "sets")
    facts = info.where("shared < 0").drop("shared")
    signature = ["n", "sign_a", "sign_b"]
    classes = facts.where("n > 0").groupBy(*signature).agg(F.min("doc_id").alias("rep"))
    owners = facts.join(classes, signature, "left").select("doc_id", "n", "s", F.coalesce("rep", "doc_id").alias("rep"))
    owners = materialize(owners, "classes")
    shared = info.where("shared >= 0").groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    d = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)
    may = owners.where("n > 0").join(shared, "doc_id", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("s") - d)
    reps = may.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(binary(known).join(reps, "doc_id", "left_semi"), "candidates")
    tokens = texts.mapInArrow(_all_tokens(size, buckets), PACKED)
    back = tokens.groupBy("bucket").applyInArrow(_frequencies(buckets), PACKED)
    postings = back.groupBy("bucket").applyInArrow(_prefixes(percent), _POSTING)
    labels = _linked(texts, materialize(postings, "postings"), size, percent)
    named = owners.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    if nameless.isEmpty():
        return out
    sizes = nameless.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    count = sizes.mapInArrow(_sizes(size), "n_shingles long")
    none = F.lit(None).cast("long")
    return out.unionByName(count.select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))


def _sizes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _blocks(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(sets.sizes().astype(np.int64))], ["n_shingles"])

    return run


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, columns as they are; rows without id stay."""
    found = near_duplicates(docs, **options)
    return without(docs, found.where("doc_id <> component_id").select("doc_id"), docs[options.get("id_col", "doc_id")])
