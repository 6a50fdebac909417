"""Repeated passages, confirmed by hashing and located by Aho-Corasick automata.

1. Every window of consecutive words has one anchor: its least phrase of ``PHRASE`` words by hash. Equal windows have
   equal anchors, so all places of a window meet under their anchor's hash, and only a few phrases per hundred words
   are shuffled, each with the hashes of its windows. Within an anchor windows are told apart by 48 further bits.
2. Windows found at two places or more are confirmed; consecutive ones form the recurring passages of a document.
3. The documents are streamed in shards of bounded size. Each shard compiles an automaton over the word sequences of
   its distinct recurring passages and runs all of its documents through it; what the automaton finds is removed.

Anchors that very many documents share are counted first. Their rows are salted, and their windows are counted with
partial sums instead of being compared in memory; so are those of any anchor with more than ``HELD`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymill.llm.tables import bounded_batches, row_key, text_of
from skymill.llm.words import Rolling, batches, ids_of
from skymill.runtime import cut

PHRASE = 12  # words of an anchor
HOT_SHARE = 1 / 1000  # anchors with at least this share of all anchors are salted: at most 1,000 of them
SALTS = 64
HELD = 50_000  # rows of one anchor compared in memory; anchors with more are counted by sums
HASH_BYTES = 6
SHARD_WORDS = 200_000  # words of the documents that share an automaton

FOUND = "doc_id long, _key long, first int, mask long, h long, hashes binary"


def window_anchors(ids: np.ndarray, doc: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (anchor hash, first window, windows) and the hash of every window.

    ``doc`` numbers the document of each word; windows do not cross documents. Of equal phrases the first is the anchor.
    """
    n = len(ids) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    rolling = Rolling(ids)
    phrases, windows = rolling.of(phrase), rolling.of(window)
    best, width, span = np.arange(len(phrases)), 1, window - phrase + 1
    while width < span:  # leftmost least phrase of every stretch of `span` phrases, by doubling
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        best = np.where(phrases[left] <= phrases[right], left, right)
        width += step
    valid = doc[:n] == doc[window - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(0, np.uint64), none, none, windows
    anchor = best[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(at)))
    return phrases[anchor[starts]], at[starts], counts, windows


def _word_batches(pdf_texts: list[str]) -> Iterator[tuple[int, list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, its words and the following texts' words, ids, number of the text of each word, first word of each text)."""
    for a, b in batches(pdf_texts):
        words = [t.encode().split() for t in pdf_texts[a:b]]  # on bytes, splits at ASCII white space only
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        total = int(sizes.sum())
        ids = ids_of((x for w in words for x in w), total)
        yield a, words, ids, np.repeat(np.arange(len(words)), sizes), np.concatenate([[0], np.cumsum(sizes)])


def _hot_anchors(rows: DataFrame, window: int, phrase: int) -> np.ndarray:
    """Hashes of anchors with a large share of all anchors, exactly counted; at most ``1 / HOT_SHARE``."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, _, ids, doc, _ in _word_batches(pdf["text"].tolist()):
                h, n = np.unique(window_anchors(ids, doc, window, phrase)[0], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    counts = cut(rows.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    single = rows.count()
    least = max(1000, int((counts.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE), int(single * HOT_SHARE))
    return np.array(sorted(r["h"] for r in counts.where(F.col("n") >= least).select("h").collect()), dtype=np.int64)


def confirmed(docs: DataFrame, window: int = 35, phrase: int = PHRASE) -> DataFrame:
    """``doc_id, _key, first, mask``: bit ``i`` of the mask is set if the window at word ``first + i`` starts elsewhere too."""
    if not 0 < phrase <= window < phrase + 63:
        raise ValueError("an anchor has between 1 and 63 windows")
    rows = bounded_batches(docs).select("doc_id", row_key().alias("_key"), text_of().alias("text"))
    hot = _hot_anchors(rows, window, phrase)
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("h", pa.int64()), ("salt", pa.int32()), ("first", pa.int32()), ("hashes", pa.binary())])

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keys = batch.column(1).to_numpy()
            texts = batch.column(2).to_pylist()
            for a, words, ids, doc, begins in _word_batches(texts):
                h, first, n, windows = window_anchors(ids, doc, window, phrase)
                if not len(h):
                    continue
                of = doc[first]
                chosen = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                raw = np.ascontiguousarray(windows[chosen].view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :])
                offsets = np.concatenate([[0], np.cumsum(n * HASH_BYTES)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                h = h.view(np.int64)
                salt = np.where(np.isin(h, hot), 1 + (keys[a + of] % SALTS), 0).astype(np.int32)
                ids_here = batch.column(0).take(pa.array(a + of))
                yield pa.RecordBatch.from_arrays([ids_here, pa.array(keys[a + of]), pa.array(h), pa.array(salt), pa.array((first - begins[of]).astype(np.int32)), packed], schema=schema)

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last anchor, which may go on in the next batch
        passing = None  # an anchor with more rows than are held
        for batch in parts:
            table = pa.Table.from_batches([batch])
            if passing is not None:
                other = np.flatnonzero(table.column("h").to_numpy() != passing)
                k = int(other[0]) if len(other) else table.num_rows
                yield from unsettled(table.slice(0, k))
                table = table.slice(k)
            if not table.num_rows:
                continue
            passing = None
            table = table if held is None else pa.concat_tables([held, table])
            h = table.column("h").to_numpy()
            other = np.flatnonzero(h != h[-1])
            k = int(other[-1]) + 1 if len(other) else 0
            yield from settle(table.slice(0, k))
            held = table.slice(k)
            if held.num_rows > HELD:
                yield from unsettled(held)
                held, passing = None, h[-1]
        if held is not None:
            yield from settle(held)

    out_schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("first", pa.int32()), ("mask", pa.int64()), ("h", pa.int64()), ("hashes", pa.binary())])

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Masks of rows whose windows recur under their anchor; rows of hot anchors pass through."""
        if not table.num_rows:
            return
        table = table.combine_chunks()
        h, salt = table.column("h").to_numpy(), table.column("salt").to_numpy()
        shared = np.zeros(len(h), dtype=bool)
        shared[1:] = h[1:] == h[:-1]
        shared[:-1] |= shared[1:]
        cold = table.filter(pa.array(shared & (salt == 0)))
        if cold.num_rows:
            h = cold.column("h").to_numpy()
            group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
            packed = cold.column("hashes").combine_chunks()
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            sizes = pc.binary_length(packed).to_numpy().astype(np.int64)
            offsets = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
            raw = np.frombuffer(packed.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, HASH_BYTES)
            wide = np.zeros((len(raw), 8), dtype=np.uint8)
            wide[:, :HASH_BYTES] = raw
            n = sizes // HASH_BYTES
            row = np.repeat(np.arange(len(n)), n)
            value, owner = wide.view(np.uint64)[:, 0], group[row]
            order = np.lexsort((value, owner))
            same = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
            again = np.zeros(len(value), dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            place = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            mask = np.zeros(len(n), dtype=np.int64)
            np.add.at(mask, row[again], np.int64(1) << place[again])
            got = np.flatnonzero(mask)
            some = cold.take(pa.array(got))
            yield from pa.Table.from_arrays(
                [some.column("doc_id"), some.column("_key"), some.column("first"), pa.array(mask[got]), pa.nulls(len(got), pa.int64()), pa.nulls(len(got), pa.binary())], schema=out_schema
            ).combine_chunks().to_batches()
        yield from unsettled(table.filter(pa.array(salt > 0)))

    def unsettled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows whose windows are counted afterwards, by sums."""
        if table.num_rows:
            nothing = pa.nulls(table.num_rows, pa.int64())
            columns = [table.column("doc_id"), table.column("_key"), table.column("first"), nothing, table.column("h"), table.column("hashes")]
            yield from pa.Table.from_arrays(columns, schema=out_schema).combine_chunks().to_batches()

    scanned = rows.mapInArrow(scan, "doc_id long, _key long, h long, salt int, first int, hashes binary")
    found = cut(scanned.repartition("h", "salt").sortWithinPartitions("h").mapInArrow(gather, FOUND))
    cold = found.where(F.col("mask").isNotNull()).select("doc_id", "_key", "first", "mask")
    if found.where(F.col("mask").isNull()).isEmpty():
        return cold
    return cold.unionByName(_counted_by_sums(found.where(F.col("mask").isNull())))


def _counted_by_sums(rows: DataFrame) -> DataFrame:
    """Masks of rows of anchors that too many documents share to be compared in memory.

    Places with the same anchor and the same windows are one row with a count first, so a passage that a third of the
    documents share is a few rows; its windows are then counted, and the places find their mask again.
    """
    kinds = cut(rows.groupBy("h", "hashes").agg(F.count(F.lit(1)).alias("n")))
    steps = F.sequence(F.lit(0), (F.octet_length("hashes") / HASH_BYTES - 1).cast("int"))
    each = F.transform(steps, lambda i: F.struct(i.alias("i"), F.substring("hashes", i * HASH_BYTES + 1, F.lit(HASH_BYTES)).alias("w")))
    windows = kinds.select("h", "hashes", "n", F.explode(each).alias("_e")).select("h", "hashes", "n", "_e.i", "_e.w")
    often = cut(windows.groupBy(F.col("h").alias("_h"), F.col("w").alias("_w")).agg(F.sum("n").alias("_n")).where("_n > 1").drop("_n"))
    again = windows.join(often, (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w")))
    masks = cut(again.groupBy(F.col("h").alias("_h"), F.col("hashes").alias("_hashes")).agg(F.sum(F.expr("shiftleft(1L, i)")).alias("_mask")))
    placed = rows.join(masks, (F.col("h") == F.col("_h")) & (F.col("hashes") == F.col("_hashes")))
    return placed.select("doc_id", "_key", "first", F.col("_mask").alias("mask"))


def covered(marks: list[tuple[int, int]], n_words: int, window: int) -> np.ndarray:
    """Which of a document's words lie in a confirmed window."""
    firsts, masks = np.array(marks, dtype=np.int64).T
    row, bit = np.nonzero((masks[:, None] >> np.arange(63)) & 1)
    starts = np.unique(firsts[row] + bit)
    edge = np.zeros(n_words + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def locate(documents: list[list[bytes]], passages: set[tuple[bytes, ...]]) -> list[np.ndarray]:
    """For each document, which words lie in an occurrence of a passage, found by one automaton over word sequences."""
    import ahocorasick

    number: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        automaton.add_word(tuple([number.setdefault(w, len(number) + 1) for w in p]), len(p))
    automaton.make_automaton()
    out = []
    for words in documents:
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for end, size in automaton.iter(tuple([number.get(w, 0) for w in words])):
            edge[end + 1 - size] += 1
            edge[end + 1] -= 1
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def remove_repeats(docs: DataFrame, window: int = 35, phrase: int = PHRASE, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) of every row.

    Words are maximal runs of non-ASCII-white-space, unchanged. Removed is each word covered by a window of ``window``
    words whose word sequence also starts at another place, of the same document or of any other; windows are those of
    the input. Null texts have no words; texts shorter than a window keep all. Repeated rows are places of their own,
    so a repeated text of a window or more is removed whole. kept_sha256: lowercase hex of the kept words joined by
    single spaces. An empty table gives no row; extra columns are left out.
    """
    marks = confirmed(docs, window, phrase)
    per_doc = cut(marks.groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).agg(F.collect_set(F.struct("first", "mask")).alias("marks")))
    rows = bounded_batches(docs).select("doc_id", row_key().alias("_key"), text_of().alias("text"))
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def shard(ids: list, documents: list[list[bytes]], marked: list) -> pd.DataFrame:
        passages: set[tuple[bytes, ...]] = set()
        for words, m in zip(documents, marked):
            if m is not None:
                flags = covered([(x["first"], x["mask"]) for x in m], len(words), window)
                passages.update(tuple(words[a:b]) for a, b in stretches(flags))
        gone = locate(documents, passages) if passages else [None] * len(documents)
        out = []
        for doc_id, words, flags in zip(ids, documents, gone):
            kept = words
            if flags is not None and flags.any():
                kept = [words[i] for i in np.flatnonzero(~flags)]
            text = b" ".join(kept)
            row = (doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest())
            out.append(row + ((text.decode(),) if with_text else ()))
        return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, documents, marked, size = [], [], [], 0
            for doc_id, text, m in zip(pdf["doc_id"], pdf["text"], pdf["marks"]):
                words = text.encode().split()
                if size and size + len(words) > SHARD_WORDS:
                    yield shard(ids, documents, marked)
                    ids, documents, marked, size = [], [], [], 0
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                documents.append(words)
                marked.append(m)
                size += len(words)
            if ids:
                yield shard(ids, documents, marked)

    return joined.select("doc_id", "text", "marks").mapInPandas(stream, schema)
