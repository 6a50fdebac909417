"""Benchmark decontamination with spaced seeds: hits under substitutions, verified by aligning around them.

A seed is the hash of the words at the ones of a mask; the words at its zeros may differ. Seeds of the benchmark and of
the documents are joined on (mask, hash). A hit fixes an alignment of a document and an item, along which the words
are compared and the best stretch is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymill.llm.tables import bounded_batches, row_key, text_of, without_rows
from skymill.llm.words import batches, ids_of, mixed
from skymill.runtime import cut

# Wherever 2 of 12 words, 3 of 15 or 4 of 20 are substituted, one of these fits between them. Any longer stretch with 80 %
# equal words has a part of 12 to 23 words with 80 % equal, so none is missed.
MASKS = ("1111011", "110010111", "11000100111")
# The same for items of fewer words, which must be there whole: wherever a fifth of the words is substituted, ends included.
SHORT_MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"),
    10: ("1111101", "11100111", "1101010011", "10110111", "1100101011"),
    11: ("1111011", "110010111", "1101100101", "111111"),
}
MIN_WORDS = 12  # shortest stretch that counts; items that are no longer must be there whole
MIN_MATCH = 0.8  # share of equal words in it
SHORTEST = 3  # items of fewer words are not looked for unless asked: nearly every document holds them by chance
FILTER_BITS = 24  # the benchmark's hashes as two bit tables of this many address bits, whatever their number
BLOCK_BITS = 16

SEEDS = "item_id long, mask int, at int, h long"
HITS = "doc_id long, _key long, mask int, at int, h long"
FOUND = "doc_id long, _key long, item_id long, doc_start long, item_start long, n_words long, n_equal long, item_words long"

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normal_words(text: str) -> list[bytes]:
    """Runs of letters and digits, lower-cased; every character beyond ASCII counts as a letter."""
    return _WORD.findall(text.lower().encode())


def spread_ids(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """The words' numbers mixed apart for every place in a mask."""
    return [mixed(ids + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64)) for j in range(longest)]


def seeds(ids: np.ndarray, mask: str, spread: list[np.ndarray] | None = None) -> np.ndarray:
    """Hash of the chosen words at every place where the whole mask fits; ``spread`` as by ``spread_ids``, if at hand."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    spread = spread or spread_ids(ids, len(mask))
    total = np.full(n, xxhash.xxh64_intdigest(mask), dtype=np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            total += spread[j][j : j + n]
    return mixed(total)


def masks_of(n: int, masks: Sequence[str]) -> Sequence[str]:
    """The masks that find an item of ``n`` words."""
    return SHORT_MASKS.get(n, masks if n >= MIN_WORDS else ())


def benchmark_seeds(benchmark: DataFrame, masks: Sequence[str], used: Sequence[str], shortest: int = SHORTEST) -> DataFrame:
    """``item_id, mask, at, h``: seeds of every item of ``shortest`` words or more by its masks; ``mask`` is a place in ``used``."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for item, text in zip(pdf["item_id"], pdf["text"]):
                words = normal_words(text)
                if len(words) < shortest:
                    continue
                ids = ids_of(words, len(words))
                for m, mask in enumerate(used):
                    h = seeds(ids, mask)
                    if len(h) and mask in masks_of(len(words), masks):
                        yield pd.DataFrame({"item_id": item, "mask": m, "at": np.arange(len(h)), "h": h.view(np.int64)})

    return benchmark.where(F.col("item_id").isNotNull()).select("item_id", text_of().alias("text")).mapInPandas(scan, SEEDS)


def _tables(seed_rows: DataFrame) -> np.ndarray:
    """Two bit tables of all hashes: 2 x 2**FILTER_BITS bits pass through the driver, however large the benchmark."""
    half = (1 << FILTER_BITS) - 1
    both = F.array(F.col("h").bitwiseAND(half), F.shiftrightunsigned("h", 40).bitwiseAND(half) + (half + 1))
    spots = seed_rows.select(F.explode(both).alias("spot")).distinct()
    size = 1 << BLOCK_BITS

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, dtype=np.uint8)
        bits[pdf["spot"].to_numpy() % size] = 1
        return pd.DataFrame({"block": [int(pdf["spot"].iloc[0]) >> BLOCK_BITS], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    blocks = spots.groupBy(F.shiftright("spot", BLOCK_BITS)).applyInPandas(pack, "block long, bits binary").collect()
    table = np.zeros((2 << FILTER_BITS) >> 3, dtype=np.uint8)
    for r in blocks:
        at = r["block"] * size // 8
        table[at : at + size // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table


def _maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places whose hash may be the benchmark's."""
    half = np.uint64((1 << FILTER_BITS) - 1)
    at = (h & half).astype(np.int64)
    near = np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
    at = ((h[near] >> np.uint64(40)) & half).astype(np.int64) + int(half) + 1
    return near[((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == 1]


def best_stretch(doc: np.ndarray, item: np.ndarray, shift: int, least: int, share: float) -> tuple[int, int, int] | None:
    """Longest stretch of the alignment ``doc[i + shift] ~ item[i]`` with equal words at both ends, at least ``least``
    words and at least ``share`` of them equal: (item start, words, equal words)."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < least:
        return None
    equal = doc[lo + shift : hi + shift] == item[lo:hi]
    place = np.flatnonzero(equal)
    if len(place) < share * least:
        return None
    # a stretch from the a-th to the b-th equal word is good if (b - a + 1) >= share * (place[b] - place[a] + 1)
    order = np.arange(len(place))
    up, down = order + 1 - share * (place + 1), order - share * place
    least_down = np.minimum.accumulate(down)  # over possible starts
    best = None
    for b in range(len(place) - 1, -1, -1):
        if best is not None and place[b] + 1 <= best[1]:
            break
        a = int(np.argmax(least_down <= up[b] + 1e-9)) if least_down[b] <= up[b] + 1e-9 else None
        if a is None or a > b:
            continue
        size = int(place[b] - place[a] + 1)
        if size >= least and (best is None or size > best[1]):
            best = (lo + int(place[a]), size, b - a + 1)
    return best


def whole_item(doc: np.ndarray, item: np.ndarray, shift: int, share: float) -> tuple[int, int, int] | None:
    """The whole item at ``shift``, if at least ``share`` of its words are equal there, whichever: as ``best_stretch``."""
    if shift < 0 or shift + len(item) > len(doc):
        return None
    equal = int((doc[shift : shift + len(item)] == item).sum())
    return (0, len(item), equal) if equal >= share * len(item) - 1e-9 else None


def keyed_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[str] = MASKS,
    min_words: int = MIN_WORDS,
    min_match: float = MIN_MATCH,
    shortest: int = SHORTEST,
) -> DataFrame:
    """One row per document and item that overlap: ``doc_id, _key, item_id, doc_start, item_start, n_words, n_equal, item_words``.

    Words are runs of letters and digits, lower-cased. An overlap is the longest stretch of one alignment, with at
    least ``min_words`` words of which ``min_match`` are equal, the first and the last among them; of an item of no more than
    ``min_words`` words it is the whole item, of which any ``min_match`` are equal. Only substitutions are tolerated, so an
    insertion splits an overlap. Of several alignments the longest counts, then the one with most
    equal words, then the earliest in the document. Null texts have no words; items of fewer than ``shortest`` words or
    with a null id are not looked for. The default masks find every such overlap of the default ``min_words`` and
    ``min_match`` or stricter ones. Documents without an overlap have no row. Rows that repeat a document id and
    text count once. Items that share a text give a row each. Extra columns are left out.
    """
    items = cut(benchmark.where(F.col("item_id").isNotNull()).select("item_id", text_of().alias("text")).distinct())

    @F.pandas_udf("int")
    def n_words(texts: pd.Series) -> pd.Series:
        return pd.Series([len(normal_words(t)) for t in texts], dtype="int32")

    few = [r["n"] for r in items.select(n_words("text").alias("n")).where(F.col("n").between(shortest, MIN_WORDS - 1)).distinct().collect()]
    used = list(dict.fromkeys([*masks, *[m for n in sorted(few) for m in masks_of(n, masks)]]))
    longest = max(map(len, used))
    seed_rows = cut(benchmark_seeds(items, masks, used, shortest))
    table = items.sparkSession.sparkContext.broadcast(_tables(seed_rows))
    rows = bounded_batches(docs).select("doc_id", row_key().alias("_key"), text_of().alias("text"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = table.value
        for pdf in frames:
            texts, names, keys = pdf["text"].tolist(), pdf["doc_id"], pdf["_key"].to_numpy()
            for a, b in batches(texts):
                words = [normal_words(t) for t in texts[a:b]]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                ids = ids_of((x for w in words for x in w), int(sizes.sum()))
                doc = np.repeat(np.arange(len(words)), sizes)
                begins = np.concatenate([[0], np.cumsum(sizes)])
                spread = spread_ids(ids, longest)
                for m, mask in enumerate(used):
                    h = seeds(ids, mask, spread)
                    if not len(h):
                        continue
                    at = _maybe(bits, h)
                    at = at[doc[at] == doc[at + len(mask) - 1]]
                    if len(at):
                        of = doc[at]
                        yield pd.DataFrame({"doc_id": names.iloc[a + of].to_numpy(), "_key": keys[a + of], "mask": m, "at": at - begins[of], "h": h[at].view(np.int64)}).astype({"doc_id": "Int64"})

    hits = cut(rows.mapInPandas(scan, HITS))
    right = seed_rows.select("item_id", F.col("mask").alias("_m"), F.col("at").alias("_at"), F.col("h").alias("_h"))
    met = hits.join(right, (F.col("h") == F.col("_h")) & (F.col("mask") == F.col("_m")))
    lines = met.select("doc_id", "_key", "item_id", (F.col("at") - F.col("_at")).alias("shift")).distinct()
    texts = items.select(F.col("item_id").alias("_item"), F.col("text").alias("item_text"))
    asked = lines.join(texts, F.col("item_id") == F.col("_item"))
    per_doc = cut(asked.groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).agg(F.collect_list(F.struct("item_id", "shift", "item_text")).alias("lines")))
    cases = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        for pdf in frames:
            out = []
            for doc_id, key, text, asked_lines in zip(pdf["doc_id"], pdf["_key"], pdf["text"], pdf["lines"]):
                words = normal_words(text)
                doc, best = ids_of(words, len(words)), {}
                for line in asked_lines:
                    item_text = line["item_text"]
                    if item_text not in known:
                        if len(known) > 10_000:
                            known.clear()
                        w = normal_words(item_text)
                        known[item_text] = ids_of(w, len(w))
                    item = known[item_text]
                    if len(item) <= min_words:
                        got = whole_item(doc, item, line["shift"], min_match)
                    else:
                        got = best_stretch(doc, item, line["shift"], min_words, min_match)
                    if got:
                        start, n, equal = got
                        rank = (n, equal, -(start + line["shift"]))
                        if line["item_id"] not in best or rank > best[line["item_id"]][0]:
                            best[line["item_id"]] = (rank, (doc_id, key, line["item_id"], start + line["shift"], start, n, equal, len(item)))
                out += [row for _, row in best.values()]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"doc_id": "Int64"})

    return cases.select("doc_id", "_key", "text", "lines").mapInPandas(verify, FOUND).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``keyed_overlaps`` without the hash of the text."""
    return keyed_overlaps(docs, benchmark, **options).drop("_key").distinct()


def leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, _key`` of the documents that overlap an item."""
    return keyed_overlaps(docs, benchmark, **options).select("doc_id", "_key").distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with their columns."""
    return without_rows(docs, cut(leaked(docs, benchmark, **options)))
