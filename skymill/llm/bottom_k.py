"""Near duplicates by bottom-k sketches: the k smallest values that one hash function gives a document's shingles.

The bottom k values of a union are in both sketches wherever they are in both sets, so two sets of similarity s share
about s * k retained values. Inverted lists of retained values propose pairs: a document enters the lists of so many of its
rarest values that any similar pair meets in one of them. The sketch of the union estimates the similarity of a proposed
pair; what passes is decided on the whole sets.

**Which pairs can be missed.** With sets of up to ``K`` shingles the sketch is the set and nothing is missed. Of larger sets
a pair at exactly the asked similarity shares fewer retained values than ``shared_at_least`` assumes with a probability of
at most ``MISS``; a more similar pair, less often.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.llm.links import components
from skymill.llm.tables import Sieve, row_key, sifted, text_batches, text_of
from skymill.llm.words import Rolling, ids_of
from skymill.runtime import cut

K = 64
MISS = 1e-13
FEW = 16  # members of a list that meet pair by pair
MARKS = 1024  # bits that tell whole sets apart before they are compared
NEAR = 16  # values before one that an entry of a crowded list names


def shingles_of(text: str, width: int) -> np.ndarray:
    """Sorted distinct signed 64-bit hashes of a text's runs of ``width`` words, or of all its words if it has fewer."""
    w = text.encode().lower().split()  # on bytes, both only know ASCII
    if not w:
        return np.zeros(0, np.int64)
    return np.unique(Rolling(ids_of(w, len(w))).of(min(width, len(w))).view(np.int64))


def shared_at_least(percent: int, k: int = K, miss: float = MISS) -> int:
    """The largest c such that of k values drawn from a union at least c are common, but for a chance of ``miss``."""
    p, tail, c = percent / 100, 0.0, 0
    while c < k:
        tail += comb(k, c) * p**c * (1 - p) ** (k - c)
        if tail > miss:
            break
        c += 1
    return c


def digest(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=np.int64).tolist())


def sketch(docs: DataFrame, width: int, row: str | None = None, fingerprint: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """Written: ``row, doc_id, key, n, d0, d1, sketch`` of every row, and ``f0``, what ``fingerprint`` makes of the set (0 without
    one); ``d0, d1`` are a digest of the whole set, ``key`` a hash of the text.

    ``row`` names a column that tells the rows apart; without it they are numbered here. Null texts count as empty,
    sets of texts without words are empty. Columns other than ``doc_id`` and ``text`` are left out.
    """

    @F.pandas_udf("n int, d0 long, d1 long, f0 long, sketch array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingles_of(t, width)
            rows.append((len(s), *digest(s), fingerprint(s) if fingerprint else 0, s[:K].copy()))
        return pd.DataFrame(rows, columns=["n", "d0", "d1", "f0", "sketch"], index=texts.index).astype({"n": "int32", "d0": "int64", "d1": "int64", "f0": "int64"})

    number = F.col(row) if row else F.monotonically_increasing_id()
    with text_batches(docs.sparkSession):
        return cut(docs.select(number.alias("row"), "doc_id", row_key().alias("key"), of(text_of()).alias("_s")).select("row", "doc_id", "key", "_s.*"))


def whole_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Written: ``node, shingles`` of ``nodes`` (written; ``node, key, d0, d1``), from their texts.

    Texts are found by their hash; what they are is decided by the digest of their shingles.
    """

    @F.pandas_udf("d0 long, d1 long, shingles array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles_of(t, width) for t in texts]
        digests = [digest(s) for s in sets]
        return pd.DataFrame({"d0": [d[0] for d in digests], "d1": [d[1] for d in digests], "shingles": sets}, index=texts.index)

    of = of.asNondeterministic()  # else the filter on the digests gets a call of its own, in a worker of its own
    with text_batches(docs.sparkSession):
        texts = sifted(docs.select(row_key().alias("key"), text_of().alias("text")), "key", nodes, "key")
        one = texts.groupBy(F.col("key").alias("_k"), F.xxhash64(F.lit(1), "text").alias("_other")).agg(F.any_value("text").alias("text"))
        met = nodes.join(one, F.col("key") == F.col("_k")).select("node", "d0", "d1", of("text").alias("_s"))
        same = (F.col("d0") == F.col("_s.d0")) & (F.col("d1") == F.col("_s.d1"))
        return cut(met.where(same).groupBy("node").agg(F.any_value("_s.shingles").alias("shingles")))


def _needed(n: Column, percent: int, k: int = K) -> Column:
    """So many of a document's retained values are also retained by any partner.

    A set of n and a similar one differ in at most n * (1/s - 1) shingles, so that many of the bottom k of the union can't
    be common. If both sets fit their sketches, s * n shingles are.
    """
    apart = F.lit(k) - F.floor(n * (100 - percent) / percent)
    whole = F.ceil(n * percent / 100)
    return F.when(n <= k, F.least(whole, apart)).otherwise(F.greatest(apart, F.lit(shared_at_least(percent, k)))).cast("int")


def lists(nodes: DataFrame, percent: int) -> DataFrame:
    """Written inverted lists ``value, bin, node, n, place``: any similar pair meets in one of them.

    Each node enters the lists of its rarest retained values; values that only it retains need no list. The global order
    (rarest first, then by value) makes this a prefix filter: of two sketches that share c values, the first
    size - c + 1 of each share one. A list is cut into bins of sizes; similar sizes are in one bin or neighbouring ones,
    and a node also enters the bin above its own.
    """
    needed = _needed(F.col("n"), percent)
    step = -np.log(percent / 100)
    bins = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int")
    rare = _rarest(nodes, "sketch", needed).withColumn("_b", bins)
    return cut(rare.select("value", F.explode(F.array("_b", F.col("_b") + 1)).alias("bin"), "node", "n", "place"))


def marks_of(shingles: np.ndarray) -> np.ndarray:
    """For each of ``MARKS`` places whether an odd number of shingles fall on it. Marks of two sets differ in at most as many
    places as there are shingles that only one of the sets has."""
    odd = np.bincount(shingles & (MARKS - 1), minlength=MARKS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def marked(sets: DataFrame) -> DataFrame:
    """``node, marks`` of ``sets`` (written; ``node, shingles``)."""

    @F.pandas_udf("array<long>")
    def of(arrays: pd.Series) -> pd.Series:
        return pd.Series([marks_of(s) for s in arrays], index=arrays.index)

    return sets.select("node", of("shingles").alias("marks"))


def _rarest(nodes: DataFrame, values: str, needed: Column, near: int = 0) -> DataFrame:
    """``value, node, n, place``: of an array of values so many of the rarest that nodes which share ``needed`` of theirs
    share one of these; ``place`` counts the values before it, from rare to frequent. Values that one node has are left
    out. With ``near``, also ``near``: so many of the values before it that other nodes have too, the last ones."""
    often = cut(nodes.select(F.explode(values).alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    sieve = Sieve(often, "_v")
    passes = sieve.test()

    @F.pandas_udf("array<long>")
    def shared(arrays: pd.Series) -> pd.Series:
        return pd.Series([s[passes(s)] for s in arrays], index=arrays.index)

    entries = nodes.select("node", "n", F.size(values).alias("_size"), F.explode(shared(values)).alias("value"))
    kept = entries.join(often, F.col("value") == F.col("_v")).groupBy("node", "n", "_size").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("have"))
    alone = F.col("_size") - F.size("have")
    first = F.slice("have.value", 1, F.greatest(F.col("_size") - needed + 1 - alone, F.lit(0)))
    entry = [F.col("_e.v").alias("value"), "node", "n", (F.col("_alone") + F.col("_e.i")).alias("place")]
    named = lambda v, i: F.struct(v.alias("v"), i.alias("i"), *([F.slice("_first", F.greatest(i - near + 1, F.lit(1)), F.least(i, F.lit(near))).alias("near")] if near else []))
    entries = kept.select("node", "n", alone.alias("_alone"), first.alias("_first")).select("node", "n", "_alone", F.explode(F.transform("_first", named)).alias("_e"))
    out = cut(entries.select(*entry, *(["_e.near"] if near else [])))
    sieve.close()
    return out


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``u, v``) whose union's sketch does not rule their similarity out."""
    of = lambda side: nodes.select(F.col("node").alias(f"_{side}"), F.col("sketch").alias(f"_s{side}"), F.col("n").alias(f"_n{side}"))
    both = pairs.join(of("u"), F.col("u") == F.col("_u")).join(of("v"), F.col("v") == F.col("_v"))
    union = F.slice(F.array_sort(F.array_union("_su", "_sv")), 1, K)
    seen = both.select("u", "v", F.least("_nu", "_nv").alias("_least"), union.alias("_union"), F.array_intersect("_su", "_sv").alias("_common"))
    seen = seen.select("u", "v", "_least", F.size("_union").alias("_size"), F.size(F.array_intersect("_union", "_common")).alias("_shared"))
    apart = F.lit(K) - F.floor(F.col("_least") * (100 - percent) / percent)
    least = F.when(F.col("_size") < K, F.ceil(F.col("_size") * percent / 100)).otherwise(F.greatest(apart, F.lit(shared_at_least(percent))))
    return seen.where(F.col("_shared") >= least).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written: those of ``pairs`` with 100 * common >= percent * union, counted on the whole sets."""
    of = lambda side: sets.select(F.col("node").alias(f"_{side}"), F.col("shingles").alias(f"_s{side}"))
    both = pairs.join(of("u"), F.col("u") == F.col("_u")).join(of("v"), F.col("v") == F.col("_v"))
    counted = both.select("u", "v", F.size(F.array_intersect("_su", "_sv")).cast("long").alias("_c"), (F.size("_su") + F.size("_sv")).cast("long").alias("_t"))
    return cut(counted.where(100 * F.col("_c") >= percent * (F.col("_t") - F.col("_c"))).select("u", "v"))


def _with_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    known = entries.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    return known.withColumn("root", F.coalesce("root", "node")).drop("_n")


def linked_nodes(nodes: DataFrame, docs: DataFrame, width: int, percent: int, proposed: DataFrame | None = None) -> DataFrame:
    """``node, root`` of the components of all similar pairs; nodes without a partner are not returned.

    ``proposed`` (``u, v``) are likely pairs from elsewhere: verified with the first ones, they leave less to be compared.

    First every list meets around two members, so that crowds of copies join with as many comparisons as they have
    entries. Lists whose members are all connected then are done. In others of up to ``FEW`` members all that are apart meet.
    Members of longer ones get lists of their whole sets, which are exact and much shorter. There all meet those outside the
    list's largest component, at the first value they share, except where its places or the marks of the sets already bound
    the overlap below what is asked. Only pairs that neither rules out are written and compared on the sets.
    """
    fits = lambda a, b: (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)
    pair = [F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")]
    fetch = lambda some: whole_sets(docs, cut(nodes.join(some, F.col("node") == F.col("_some")).select("node", "key", "d0", "d1")), width)

    entries = lists(nodes, percent)
    of_list = (F.col("value") == F.col("_value")) & (F.col("bin") == F.col("_bin"))
    by_list = [F.col("value").alias("_value"), F.col("bin").alias("_bin")]
    other = [F.col("node").alias("other"), F.col("n").alias("other_n")]
    # where a value stands early, few values are the node's own: it is central among its copies
    middle = [F.min(F.struct("place", F.xxhash64("node").alias("_h"), *other)), F.max(F.struct(F.xxhash64("node").alias("_h"), F.lit(0).alias("_p"), *other))]
    middle = F.array(*[F.struct(m["other"].alias("other"), m["other_n"].alias("other_n")) for m in middle])
    stars = entries.groupBy(*by_list).agg(middle.alias("_m"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    starred = cut(entries.join(stars, of_list).drop("_value", "_bin"))
    met = starred.select("node", "n", F.explode("_m").alias("_m")).select("node", "n", "_m.other", "_m.other_n")
    met = met.where((F.col("node") != F.col("other")) & fits("n", "other_n")).select(*pair)
    if proposed is not None:
        met = met.unionByName(proposed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    pairs = cut(met.distinct())
    ends = lambda found: found.select(F.explode(F.array("u", "v")).alias("_some"))
    likely = cut(estimated(pairs, nodes, percent))
    links = verified(likely, fetch(ends(likely).distinct()), percent)
    roots = cut(components(links))

    known = _with_roots(starred.where(~F.array_contains(F.col("_m.other"), F.col("node"))).drop("_m"), roots)
    mixed = known.groupBy(*by_list).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi")
    known = cut(known.join(mixed.select("_value", "_bin"), of_list).drop("_value", "_bin"))
    few = known.where(F.col("_c") <= FEW)
    met = few.join(few.select(*by_list, *other, F.col("root").alias("other_root")), of_list & (F.col("node") < F.col("other")) & (F.col("root") != F.col("other_root")) & fits("n", "other_n"))
    likely = cut(estimated(cut(met.select(*pair).distinct()), nodes, percent))
    crowds = known.where(F.col("_c") > FEW).select(F.col("node").alias("_some"))
    still = cut(crowds.unionByName(ends(likely)).distinct())
    if still.isEmpty():
        return roots
    sets = fetch(still)
    size = F.size("shingles")
    with text_batches(docs.sparkSession):
        of_node = cut(_with_roots(marked(sets), roots)).withColumnRenamed("node", "_n")
    exact = _rarest(sets.select("node", size.alias("n"), "shingles"), "shingles", F.ceil(F.col("n") * percent / 100).cast("int"), NEAR)
    exact = cut(exact.join(of_node, F.col("node") == F.col("_n")).drop("_n"))
    shares = exact.groupBy("value", "root").agg(F.count(F.lit(1)).alias("_c"))
    main = shares.groupBy(F.col("value").alias("_value")).agg(F.max(F.struct("_c", "root")).alias("_m"), F.count(F.lit(1)).alias("_roots")).where("_roots > 1")
    same = F.col("value") == F.col("_value")
    mixed = cut(exact.join(main.select("_value", F.col("_m.root").alias("_main")), same).drop("_value"))
    rest = [F.col(c).alias(f"other_{c}") for c in ("place", "near", "marks", "root")]
    apart = cut(mixed.where("root <> _main").select(F.col("value").alias("_value"), *other, *rest))
    once = (F.col("root") == F.col("_main")) | (F.col("node") < F.col("other"))
    both = F.col("n") + F.col("other_n")
    # at the first common value, all that can be common are it and what follows; pairs that meet again have no say there
    enough = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place")) * (100 + percent) >= both * percent
    differ = sum(F.bit_count(F.col("marks")[i].bitwiseXOR(F.col("other_marks")[i])) for i in range(MARKS // 64))
    close = (both - differ) * (100 + percent) >= both * 2 * percent
    again = F.arrays_overlap("near", "other_near")
    met = mixed.join(apart, same & (F.col("root") != F.col("other_root")) & once & fits("n", "other_n") & enough & close & ~again)
    found = verified(cut(met.select(*pair).unionByName(likely).distinct()), sets, percent)
    return roots if found.isEmpty() else components(links.unionByName(found))


def near_groups(
    docs: DataFrame,
    width: int,
    percent: int,
    row: str | None = None,
    fingerprint: Callable[[np.ndarray], int] | None = None,
    propose: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``row, doc_id, n, root`` of every row: ``root`` is the same for all rows of a component; ``row`` and ``fingerprint`` as in
    ``sketch``; ``propose`` gives likely pairs of nodes (``node, n, f0``).

    Rows with equal sets are one node, however many they are. Rows without words are alone: their root is null.
    """
    rows = sketch(docs, width, row, fingerprint)
    same = ["n", "d0", "d1"]
    nodes = rows.where("n > 0").groupBy(*same).agg(F.min(F.struct("row", "key", "f0", "sketch")).alias("_r"))
    nodes = cut(nodes.select(F.col("_r.row").alias("node"), *same, "_r.key", "_r.f0", "_r.sketch"))
    roots = linked_nodes(nodes, docs, width, percent, propose(nodes) if propose else None).withColumnRenamed("node", "_node")
    named = nodes.join(roots, F.col("node") == F.col("_node"), "left").select(*[F.col(c).alias(f"_{c}") for c in same], F.coalesce("root", "node").alias("root"))
    on = (F.col("d0") == F.col("_d0")) & (F.col("d1") == F.col("_d1")) & (F.col("n") == F.col("_n"))
    return rows.join(cut(named), on, "left").select("row", "doc_id", "n", "root")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents link if the sets of their runs of ``width`` words have 100 * common >= percent * union; component_id is
    the smallest doc_id reachable, and the row that has it is kept. Null ids count as larger than any: a component of null
    ids only has null, and all its rows are kept. Rows that repeat an id are all kept or all not. Texts that are null,
    empty or without words have the empty set and are alone. An empty table gives no row; extra columns are left out.
    """
    groups = cut(near_groups(docs, width, percent))
    least = groups.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("_least"))
    named = groups.join(cut(least), F.col("root") == F.col("_root"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
