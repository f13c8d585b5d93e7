"""Benchmark decontamination by SimHash of item-sized windows (operator 3, native).

For every benchmark item, the windows of its own length in all documents are compared with it:

1. Windows. A similarity of 0.8 over five-word shingles leaves at most a fifth of an item's
   shingles unmatched, so a similar window holds one of the fifth and one more that are rarest in
   the benchmark. One pass over all words of all documents, as narrow rows, finds these. Around
   them the item's shingles are counted, and every window at any start that holds enough of them,
   wherever they stand in the item, is cut out. Equal windows go on as one.
2. SimHash. A window's 64-bit fingerprint takes each bit by the weighted vote of its
   shingles, weights being how often they occur.
3. Multi-index Hamming blocks. Fingerprints are cut into five blocks. If two differ in at most
   19 bits, at least one block differs in at most 3, so an item is listed under every value
   within 3 bits of each of its blocks, and windows look up their own five block values: all
   fingerprints within the radius are found, and the exact distance is checked then.
4. Exact weighted similarity (common over joint shingle weight) verifies the candidates.

Step 1 loses no window of the similarity asked for, parts of a passage may be moved. A similarity
of 0.8 means about 9 differing bits with a spread of 3, so a radius of 19 leaves out
fewer than one in a thousand of the weakest matches and practically none of the closer ones.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.tables import materialize, without

SPACE = r"\x20\x09-\x0D"
SHINGLE = 5
BLOCKS = (13, 13, 13, 13, 12)
RADIUS = 19


def _shingles(rows: DataFrame, size: int) -> DataFrame:
    """``_shingles``: hashes of all runs of ``size`` words of ``_text``; ``_size``: number of words."""
    keep = [c for c in rows.columns if c != "_text"]
    words = F.array_remove(F.split(F.lower(F.coalesce("_text", F.lit(""))), f"[{SPACE}]+"), "")
    rows = rows.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_hash"))
    starts = F.slice("_hash", F.lit(1), F.greatest(F.size("_hash") - (size - 1), F.lit(0)))
    grams = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get("_hash", i + k) for k in range(1, size))))
    return rows.select(*keep, F.size("_hash").alias("_size"), grams.alias("_shingles"))


def fingerprint(shingles: str) -> Column:
    """SimHash of an array of 64-bit hashes; a repeated hash votes as often as it occurs."""
    vote = f"aggregate({shingles}, 0, (s, x) -> s + 2 * cast(shiftright(x, b) & 1L AS int) - 1)"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if({vote} > 0, 1L, 0L), b))")


def _blocks(value: Column) -> Column:
    """(block number, block value) of a fingerprint."""
    parts, at = [], 0
    for k, width in enumerate(BLOCKS):
        part = F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        parts.append(F.struct(F.lit(k).alias("block"), part.alias("value")))
        at += width
    return F.array(*parts)


def _neighbours(items: DataFrame) -> DataFrame:
    """Items under every block value within the radius's share of their own."""
    near = RADIUS // len(BLOCKS)
    listed = items.select("_item", "item_words", F.explode(_blocks(F.col("item_print"))).alias("b"))
    wide = 1 << max(BLOCKS)
    flips = F.explode(F.filter(F.sequence(F.lit(0), F.lit(wide - 1)), lambda x: F.bit_count(x) <= near)).alias("flip")
    listed = listed.select("_item", "item_words", F.col("b.block").alias("block"), F.col("b.value").alias("value"), flips)
    width = F.element_at(F.array(*map(F.lit, BLOCKS)), F.col("block") + 1)
    listed = listed.where(F.col("flip") < F.pow(F.lit(2), width))
    return listed.select("_item", "item_words", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))


def _leads(items: DataFrame, percent: int) -> DataFrame:
    """``_shingle, _item, _wide``: of each item the shingles one of which every similar window holds.

    Of an item's shingles ``percent`` must be in the window, so it can not miss one more than the
    rest of them. The rarest in the benchmark are taken. ``_wide`` is the number of all its shingles.
    """
    each = items.select("_item", F.size("item_shingles").alias("_wide"), F.explode("item_shingles").alias("_shingle"))
    common = each.groupBy("_shingle").agg(F.count("*").alias("_common"))
    ranked = each.join(common, "_shingle").groupBy("_item", "_wide")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("_common", "_shingle"))).alias("_ranked"))
    most = F.expr(f"_wide - ceil({percent} * _wide / 100D) + 1").cast("int")
    return ranked.select(
        F.explode(F.array_distinct(F.slice("_ranked", F.lit(1), most)["_shingle"])).alias("_shingle"), "_item", "_wide"
    )


def _lead_hits(docs: DataFrame, leads: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, _n, _pos, _shingle, _item, _wide``: where a lead stands; ``_n``: shingles of the document."""
    # the outer form, as Spark derives such a filter from the inner one
    pos = F.posexplode_outer("_shingles").alias("_pos", "_shingle")
    at = docs.select("doc_id", "text_hash", (F.col("_size") - (size - 1)).alias("_n"), "_shingles")
    return at.select("doc_id", "text_hash", "_n", pos).join(leads, "_shingle")


def _regions(docs: DataFrame, leads: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, _item, _from, _window, _region``: document shingles around lead shingles.

    A document is cut into stretches as long as the item; a stretch with a lead is given out with all
    windows that reach into it. Positions travel as narrow rows; documents meet one row of stretches.
    """
    keys = ["doc_id", "text_hash"]
    at = _lead_hits(docs, leads, size)
    window = F.least("_wide", "_n")
    wanted = at.select(*keys, "_item", window.alias("w"), F.floor(F.col("_pos") / window).cast("int").alias("b")).distinct()
    wanted = wanted.groupBy(*keys).agg(F.collect_list(F.struct("_item", "w", "b")).alias("_wanted"))
    wanted = materialize(wanted.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash_of"}), "leak-stretches")
    same = docs["doc_id"].eqNullSafe(wanted["_doc"]) & (docs["text_hash"] == wanted["_hash_of"])
    met = docs.join(wanted, same).select(*keys, "_shingles", "_wanted")
    cut = F.expr(
        """transform(_wanted, x -> named_struct('_item', x._item, '_window', x.w, '_from', greatest(0, (x.b - 1) * x.w + 1),
        '_region', slice(_shingles, greatest(0, (x.b - 1) * x.w + 1) + 1,
        (x.b + 2) * x.w - 1 - greatest(0, (x.b - 1) * x.w + 1))))"""
    )
    return met.select(*keys, cut.alias("_cut")).select(*keys, F.inline("_cut"))


def _windows(regions: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Every window of a region that holds as many of the item's shingles as the similarity needs.

    ``need`` of them among the window's and the item's shingles; whenever that many hits lie
    within a window's width, all windows around them are taken.
    """
    near = regions.join(items.select("_item", "item_words", "item_shingles"), "_item")
    hits = "filter(sequence(0, size(_region) - 1), i -> array_contains(item_shingles, _region[i]))"
    need = f"cast(ceil({percent} * (_window + size(item_shingles)) / {100 + percent}D) as int)"
    near = near.select("*", F.expr(hits).alias("_hits"), F.expr(need).alias("_need")).where("size(_hits) >= _need")
    starts = F.expr(
        """array_distinct(flatten(transform(
        filter(sequence(0, size(_hits) - _need), i -> _hits[i + _need - 1] - _hits[i] < _window),
        i -> sequence(greatest(0, _hits[i + _need - 1] - _window + 1), least(_hits[i], size(_region) - _window)))))"""
    )
    cut = F.transform(
        starts,
        lambda s: F.struct(
            (F.col("_from") + s).alias("start"), F.slice("_region", s + 1, F.col("_window")).alias("shingles")
        ),
    )
    return near.select("doc_id", "text_hash", "item_words", F.inline(cut))


def _matches(docs: DataFrame, items: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified (document, item, start) matches under shingles of ``size`` words."""
    docs, items = _shingles(docs, size), _shingles(items, size)
    items = items.select("item_id", F.col("_size").alias("item_words"), F.col("_shingles").alias("item_shingles")).distinct()
    items = items.withColumn("_item", F.xxhash64("item_id", "item_shingles"))  # rows may share an id or have none
    items = items.withColumn("item_print", fingerprint("item_shingles"))
    # filters on the stored table only: pushed below, they would compute the shingles anew per word
    items = materialize(items, "benchmark-items").where("size(item_shingles) > 0")
    leads = materialize(_leads(items, percent), "benchmark-leads")
    windows = _windows(_regions(docs, leads, size), items, percent)
    windows = windows.withColumn("content", F.xxhash64("item_words", "shingles"))
    windows = materialize(windows.dropDuplicates(["doc_id", "text_hash", "item_words", "start"]), "windows")
    contents = windows.groupBy("content", "item_words").agg(F.first("shingles").alias("shingles"))
    contents = materialize(contents.withColumn("print", fingerprint("shingles")), "window-prints")
    keys = contents.select("content", "item_words", F.explode(_blocks(F.col("print"))).alias("b"))
    keys = keys.select("content", "item_words", F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    pairs = keys.join(_neighbours(items), ["block", "value", "item_words"]).select("content", "_item").distinct()
    pairs = pairs.join(contents, "content").join(items.drop("item_words"), "_item")
    pairs = pairs.withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    pairs = pairs.where(F.col("hamming") <= RADIUS)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    common = F.aggregate(
        F.transform(F.array_distinct("shingles"), lambda x: F.least(count("shingles", x), count("item_shingles", x))),
        F.lit(0),
        lambda total, n: total + n,
    )
    pairs = pairs.withColumn("common", common)
    pairs = pairs.withColumn("joint", F.size("shingles") + F.size("item_shingles") - F.col("common"))
    pairs = pairs.where(100 * F.col("common") >= percent * F.col("joint"))
    pairs = pairs.select("content", "item_id", "hamming", (F.col("common") / F.col("joint")).alias("similarity"))
    found = windows.select("doc_id", "text_hash", "item_words", "start", "content").join(pairs, "content")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "item_words", "hamming")).alias("best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 80,
) -> DataFrame:
    """``doc_id, text_hash, item_id, start, n_words, hamming, similarity``: the best window of each document and item.

    Words are compared in lower case. A window at a document's edge is moved inside; a document
    shorter than the item is one window. Items with fewer than five words are compared by
    shingles of all their words. Null or empty texts and items match nothing. Repeated rows count
    once; rows with equal ids but other texts stay apart by ``text_hash``. Other columns are
    not read; empty tables give an empty one.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    docs = docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("text_hash"), F.col(text_col).alias("_text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("_text"))
    words = F.size(F.array_remove(F.split(F.coalesce("_text", F.lit("")), f"[{SPACE}]+"), ""))
    items = items.withColumn("_n", words)
    short = [r[0] for r in items.where(F.col("_n").between(1, SHINGLE - 1)).select("_n").distinct().collect()]
    found = _matches(docs, items.where(F.col("_n") >= SHINGLE).drop("_n"), SHINGLE, percent)
    for n in sorted(short):  # at most four lengths
        found = found.unionByName(_matches(docs, items.where(F.col("_n") == n).drop("_n"), n, percent))
    return found.select(
        "doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("start"), F.col("best.item_words").alias("n_words"),
        F.col("best.hamming").alias("hamming"), F.col("best.similarity").alias("similarity"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, columns as they are."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    mine = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return without(docs, found.select("doc_id", "text_hash"), docs[id_col], mine)
