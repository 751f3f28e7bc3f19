"""Near-duplicates by bottom-k sketches, inverted lists and exact confirmation.

Every text becomes a set of hashed shingles; its sketch is the ``k`` smallest hashes, all
from one hash function. Texts with equal sets are one class and go on as one node.

1. Two sets with the wanted similarity share most of what their sketches retain. Nodes of
   which too few retained values occur in any other sketch cannot be linked and are done.
   "Too few" is six standard deviations below the mean of shared values at the threshold;
   sets smaller than a sketch are counted exactly.
2. The others get a wide sketch of ``wide`` values. In the order of how many nodes hold a
   value, rarest first, two linked nodes must share one of their first few values (prefix
   filter), so only these go into inverted lists. A value of a passage that a third of all
   texts hold stands last in that order and enters a list only for texts made of little else.
3. In each list every node meets one pivot, its most typical member; each node keeps the
   pivot it meets in most lists. Sizes and what the two can still share from that value on,
   then the similarity estimated on the sketch of the union, then the exact similarity of
   the full sets decide. This joins nearly all of a large group with one pair per node.
4. In lists that still hold several components, all pairs from different components are
   confirmed in the same way. Pairs within a component would change nothing.

No pair of a group of copies is listed, no list is gathered in one task, and nothing is
capped: what step 3 does not join step 4 compares in full.

Texts without words are linked with nothing. Rows without an id get no component and stay.
Rows that share an id are one document: its links are those of all its texts. Repeated rows
give equal rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatelight.llm.common import id_and_text, packed_longs, slices, texts_of, written
from gatelight.llm.graph import components
from gatelight.llm.shingles import Shingles
from gatelight.llm.word_ids import forget_words

#: Links hold from this many hundredths of the union, unless a caller asks for others.
PERCENT = 85

_SKETCH = "doc_id long, version long, n_shingles long, s1 long, s2 long, sketch array<long>"
_SET = "node long, n long, shingles array<long>"


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """Size, signature and sketch of the set of every text; ``version`` tells the texts of one id apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        shingles = Shingles()
        for batch in slices(batches, 512, "text"):
            sets = [shingles.of(t) for t in texts_of(batch, "text")]
            marks = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8")
            arrays = [batch.column("doc_id"), batch.column("version"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[::2]), pa.array(marks[1::2]), packed_longs([s[:k].view(np.int64) for s in sets])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "version", "n_shingles", "s1", "s2", "sketch"])

    return id_and_text(docs).withColumn("version", F.xxhash64("text")).mapInArrow(work, _SKETCH)


def _shared_at_least(n: Column, k: int, percent: int) -> Column:
    """How many of ``k`` retained values a set of ``n`` must share with any set it is linked to."""
    p = percent / 100
    most = max(1, int(np.floor(k * p - 6 * np.sqrt(k * p * (1 - p)))))
    return F.least(F.floor((n * percent + 99) / 100).cast("long"), F.lit(most).cast("long"))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The full sets, ascending, of the texts named by ``node`` and ``version``."""
    texts = id_and_text(docs).withColumn("version", F.xxhash64("text")).withColumnRenamed("doc_id", "node")
    # Of repeated rows one is enough.
    own = texts.join(nodes.select("node", "version"), ["node", "version"]).groupBy("node", "version").agg(F.first("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        shingles = Shingles()
        for batch in slices(batches, 512, "text"):
            sets = [shingles.of(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), packed_longs([s.view(np.int64) for s in sets])], ["node", "n", "shingles"])

    return own.select("node", "text").mapInArrow(work, _SET)


def _lists(sets: DataFrame, wide: int, percent: int) -> DataFrame:
    """The inverted lists: ``value``, ``node``, its size ``n``, how ``typical`` it is (mean number of nodes that hold its values), and how many values are left (``rest``) from this one on."""
    values = sets.select("node", "n", F.explode(F.slice("shingles", 1, wide)).alias("value"))
    held = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    rows = values.join(held, "value")
    of_node = W.partitionBy("node", "n")
    size = F.least(F.col("n"), F.lit(wide))
    ranked = rows.withColumn("rank", F.row_number().over(of_node.orderBy("df", "value"))).withColumn("met", F.count("*").over(of_node)).withColumn("typical", F.sum("df").over(of_node) / size)
    # Values that no other node holds come first in the order but make no list.
    first = size - _shared_at_least(F.col("n"), wide, percent) + 1
    return ranked.filter(F.col("rank") <= first - (size - F.col("met"))).select("value", "node", "n", "typical", (F.col("met") - F.col("rank") + 1).alias("rest"))


def _may_be_linked(n: Column, rest: Column, m: Column, others: Column, wide: int, percent: int) -> Column:
    """Whether two nodes that meet in a list can be linked.

    Their sizes must be similar, and if the list's value is the first they share in the
    order, they share at most what is left of either from there on. Linked nodes pass in
    the list of their first shared value, so none is lost.
    """
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    most = F.least(rest, others)
    whole = most * 100 >= (n + m - most) * percent
    return sizes & F.when(F.greatest(n, m) <= wide, whole).otherwise(most >= F.greatest(_shared_at_least(n, wide, percent), _shared_at_least(m, wide, percent)))


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (``a``, ``b``) those whose full sets are similar enough, after the estimate on the union's sketch."""

    def met(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
        for end in ("a", "b"):
            left = left.join(right.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
        return left

    both = met(pairs.select("a", "b"), sketches, ["sketch"])
    common = F.array_intersect("sketch_a", "sketch_b")
    union = F.slice(F.array_sort(_unsigned(F.array_union("sketch_a", "sketch_b"))), 1, k)
    shared = F.size(F.array_intersect(union, _unsigned(common)))
    sure = int(np.floor(k * percent / 100 - 6 * np.sqrt(k * percent / 100 * (1 - percent / 100))))
    # A union smaller than the sketch is known whole.
    near = both.filter(F.when(F.size(union) < k, shared * 100 >= F.size(union) * percent).otherwise(shared >= sure)).select("a", "b").distinct()
    full = met(near, sets, ["n", "shingles"])
    inner = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return full.filter(inner * 100 >= (F.col("n_a") + F.col("n_b") - inner) * percent).select("a", "b").distinct()


def _unsigned(values: Column) -> Column:
    """Moves 64-bit patterns so that signed order is the order of the hashes."""
    return F.transform(values, lambda x: x.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))


def _star_pairs(lists: DataFrame, wide: int, percent: int) -> DataFrame:
    """Each node with the pivot it meets in most lists."""
    pivots = lists.groupBy("value").agg(F.max(F.struct("typical", F.negative("node").alias("least"), "n", "rest")).alias("p"))
    met = lists.join(pivots, "value").select("node", (-F.col("p.least")).alias("pivot"), _may_be_linked(F.col("n"), F.col("rest"), F.col("p.n"), F.col("p.rest"), wide, percent).alias("possible"))
    counted = met.filter((F.col("node") != F.col("pivot")) & F.col("possible")).groupBy("node", "pivot").agg(F.count("*").alias("times"))
    best = counted.groupBy("node").agg(F.max(F.struct("times", F.negative("pivot").alias("least"))).alias("p"))
    return best.select(F.least("node", -F.col("p.least")).alias("a"), F.greatest("node", -F.col("p.least")).alias("b")).distinct()


def _cross_pairs(lists: DataFrame, known: DataFrame, wide: int, percent: int) -> DataFrame:
    """All pairs of a list from different components: rows outside the list's largest component against the rest."""
    rows = lists.join(known, "node", "left").select("value", "node", "n", "rest", F.coalesce("component", "node").alias("component"))
    counts = rows.groupBy("value", "component").agg(F.count("*").alias("size"))
    mains = counts.groupBy("value").agg(F.max(F.struct("size", "component")).alias("p"), F.count("*").alias("several")).filter("several > 1").select("value", F.col("p.component").alias("main"))
    live = rows.join(mains, "value")
    a, b = live.filter("component <> main").alias("a"), live.alias("b")
    # Two rows outside the largest component meet once.
    once = (F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    pairs = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.component") != F.col("b.component")) & once & _may_be_linked(F.col("a.n"), F.col("a.rest"), F.col("b.n"), F.col("b.rest"), wide, percent))
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def linked(docs: DataFrame, k: int = 32, wide: int = 1_024, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``version`` of the text, ``n_shingles``, ``component_id`` and whether the document is ``kept``; links hold from ``percent`` hundredths of the union."""
    own = written(_sketches(docs, k), "sketches")
    named = own.filter(F.col("doc_id").isNotNull())
    filled = named.filter("n_shingles > 0")
    classes = written(filled.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "version")).alias("p"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).select("s1", "s2", F.col("p.doc_id").alias("node"), F.col("p.version").alias("version"), "n", "sketch"), "classes")

    values = classes.select("node", F.explode("sketch").alias("value"))
    held = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1").select("value")
    shared = values.join(held, "value").groupBy("node").agg(F.count("*").alias("shared"))
    hopeful = classes.join(shared, "node").filter(F.col("shared") >= _shared_at_least(F.col("n"), k, percent)).select("node", "version", "sketch")
    hopeful = written(hopeful, "hopeful")
    sets = written(_sets(docs, hopeful), "sets")
    lists = written(_lists(sets, wide, percent), "lists")

    links = written(_confirmed(_star_pairs(lists, wide, percent), hopeful, sets, k, percent), "links")
    joined = components(links)
    more = written(_confirmed(_cross_pairs(lists, joined, wide, percent), hopeful, sets, k, percent), "links")

    # A document with several texts stands in several classes.
    of_class = named.join(classes.select("s1", "s2", "node"), ["s1", "s2"], "left").select("doc_id", "version", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("node"))
    torn = of_class.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("doc_id")
    bridges = of_class.join(torn, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(bridges))

    placed = of_class.join(final, "node", "left").select("doc_id", "version", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    nameless = own.filter(F.col("doc_id").isNull()).select("doc_id", "version", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return placed.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def components_of(docs: DataFrame) -> DataFrame:
    """Every document with the size of its set and the component it belongs to."""
    return linked(docs).select("doc_id", "n_shingles", "component_id", "kept")
