import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymill.llm import (
    arrow_sequences,
    block_naming,
    chat_targets,
    host_reputation,
    length_histogram,
    phrase_automata,
    rule_ensemble,
    simhash_vp,
    spaced_seeds,
    tier_packing,
)
from skymill.llm.tokens import Encoder, encoder, vocabulary
from skymill.llm.words import Rolling, ids_of

DOCS = "doc_id long, text string, h string, _key string, name string, score string, `at.x` int"  # names that operators use inside
ODD = ["", None, " ", "\n\n", "a", "A  b", "  lead", "trail ", "tab\tx", "é ß 日本", "x" * 5000, "don't I'll 1 23 !!", " nbsp", "<|endoftext|> <|im_end|>"]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "h", "k", "n", "s", 1) for i, t in zip(ids, texts)], DOCS)


def library_ids(text):
    from tokenizers import Tokenizer

    t = library_ids.__dict__.setdefault("t", Tokenizer.from_file(vocabulary()))
    return t.encode(text or "", add_special_tokens=False).ids


def prose(rnd, n, words=None):
    words = words or ["the", "of", "river", "stone", "Every", "light,", "moves", "under.", "tree", "calm", "wind", "old"]
    return " ".join(rnd.choice(words) + (str(rnd.randint(0, 99)) if rnd.random() < 0.3 else "") for _ in range(n))


def test_encoder_equals_library():
    rnd, enc = random.Random(5), Encoder(vocabulary(), limit=50)
    bits = ["a", "b ", "  ", "\n", " \n", "\t", "é", "<|endoftext|>", "'s", " 's", "1", "23", "!", "\u00a0", "\u3000", "\x1c", " don't", "ß", " x", "\r\n", "日本", "\U0001f600"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 15))) for _ in range(600)] + [t for t in ODD if t]
    for k in range(0, len(texts), 7):
        for text, raw in zip(texts[k : k + 7], enc.encode(texts[k : k + 7])):
            assert np.frombuffer(raw, enc.dtype).tolist() == library_ids(text), text


def test_encoder_can_leave_control_strings_as_text():
    plain = Encoder(vocabulary(), plain=True)
    got = np.frombuffer(plain.encode(["a <|endoftext|> b"])[0], plain.dtype).tolist()
    assert got != library_ids("a <|endoftext|> b") and plain.tokenizer.decode(got) == "a <|endoftext|> b"


def test_length_histogram(spark):
    texts = ODD + ["same words here"] * 40
    lengths = [len(library_ids(t)) for t in texts]
    rows = length_histogram.suffix_sums(length_histogram.histogram(length_histogram.encoded_lengths(docs_of(spark, texts))))
    got = {r.n_tokens: r for r in rows.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_reaching == sum(x >= n for x in lengths)
        assert r.tokens_reaching == sum(x for x in lengths if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.lost_tokens == sum(lengths) - r.truncated_tokens
        assert r.docs_within == sum(x <= n for x in lengths)
        assert abs(r.within_share - r.docs_within / len(lengths)) < 1e-12
    for r in length_histogram.at_limits(rows, [1, 2, 7, 100, 10**6]).collect():
        assert r.docs_over == sum(x > r.limit for x in lengths)
        assert r.truncated_tokens == sum(min(x, r.limit) for x in lengths)
    empty = length_histogram.encoded_lengths(docs_of(spark, []))
    assert length_histogram.suffix_sums(length_histogram.histogram(empty)).count() == 0


def test_chat_targets(spark):
    bad = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (1, 1, "assistant", bad), (1, 0, "user", bad), (2, 0, "user", "only"), (3, 0, "system", None), (3, 1, "assistant", ""), (3, 2, "assistant", "a\\|b\\\\<|"),
        (4, 0, "assistant", "x"), (4, 0, "assistant", "x"), (4, None, None, "first"), (None, 0, "user", "n"), (5, 0, "a\n\\n<|b", "\n\nt\n"), (5, 1, "assistant", "é日\U0001f600"), (5, 2, "user", "tail"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, target string")
    examples = chat_targets.expand(df)
    got = {r.conv_id: r for r in chat_targets.read_back(examples).collect()}
    by = {}
    for c, n, r, t in turns:
        by.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    assert set(got) == set(by)
    rows = examples.collect()
    for c, ts in by.items():
        ts.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in ts)
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[c].loss_chars == len(loss)
        own = [r for r in rows if r.conv_id == c]
        assert sum(r.target is not None for r in own) == sum(r == "assistant" for _, _, r, _ in ts)
        assert got[c].formatted_chars == sum(len(r.formatted) for r in own)
    assert chat_targets.read_back(chat_targets.expand(df.limit(0))).count() == 0


def test_rule_ensemble(spark):
    rnd = random.Random(1)
    good = [prose(rnd, rnd.randint(5, 80)) for _ in range(250)]
    junk = [" ".join(w.upper() + "!!" for w in prose(rnd, rnd.randint(5, 60)).split()) for _ in range(60)] + ["same " * 30] * 40
    texts = good + junk + ["", None]
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 250), 0) for i in range(350)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = rule_ensemble.classify(df, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 350]
    assert sum(r.predicted == int(r.doc_id < 250) for r in held) >= 0.95 * len(held)
    kept = rule_ensemble.keep_good(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}
    none = rule_ensemble.classify(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert rule_ensemble.classify(df.limit(0), labels).count() == 0


def test_compiled_rules_equal_rules(spark):
    import pandas as pd

    text = "If (feature 0 <= 2.5)\n If (feature 1 > 1.0E-3)\n  Predict: 1.0\n Else (feature 1 <= 1.0E-3)\n  Predict: 0.0\nElse (feature 0 > 2.5)\n Predict: 0.0\n"
    rules = rule_ensemble.rules_of_tree(text, ["a", "b"])
    assert {r.conditions for r in rules} == {(("a", "<=", 2.5),), (("a", ">", 2.5),), (("a", "<=", 2.5), ("b", ">", 0.001)), (("a", "<=", 2.5), ("b", "<=", 0.001))}
    table = pd.DataFrame({"a": [1.0, 2.5, 3.0], "b": [0.001, 0.5, 0.0]})
    model = rule_ensemble.Ensemble(0.3, [(r, 0.1 * i - 0.2) for i, r in enumerate(sorted(rules, key=lambda r: r.conditions))])
    z = 0.3 + sum(w * r.holds(table) for r, w in model.weighted)
    got = [r.p for r in spark.createDataFrame(table).select(model.score().alias("p")).collect()]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-z))))


@pytest.mark.parametrize("seed", [0, 1])
def test_packing(spark, seed):
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.choice([1, 5, 60, 300, 900])) for _ in range(60)] + [prose(rnd, 250)] * 30 * seed + ODD
    df = docs_of(spark, texts)
    rows = tier_packing.pack_documents(df).collect()
    spread, seqs = {}, {}
    for r in rows:
        spread.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(spread) == set(range(len(texts)))
    for d, parts in spread.items():
        ids, at = library_ids(texts[d]) + [0], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], dtype="<u4").tobytes())
        assert at == len(ids)
    padded = total = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and s[0].tier == (at if at & (at - 1) == 0 else 1024)
        padded, total = padded + s[0].tier, total + at
    assert padded - total <= 0.02 * total + 1024
    whole = tier_packing.cut_documents(df, with_ids=True)
    filled = tier_packing.sequences(tier_packing.pack(whole.drop("ids")), whole).collect()
    assert sum(sum(r.lengths) for r in filled) == total and all(len(r.ids) == r.tier for r in filled)
    assert tier_packing.pack_documents(df.limit(0)).count() == 0


def test_packing_plan_without_much_padding():
    rnd = random.Random(0)
    for counts in ({600: 10_000}, {1023: 5, 3: 1000}, {n: rnd.randint(1, 300) for n in range(1, 1025)}, {419: 5000, **{n: 3 for n in range(1, 1024)}}):
        rows = tier_packing.plan(counts)
        covered = Counter()
        for r in rows:
            covered[r[0]] += (r[5] - r[4]) * r[3]
        assert all(covered[n] == n * c for n, c in counts.items())
        used = {}
        for r in rows:
            used[(r[7], (r[5] - r[4]) // r[6])] = r[9]
        padded = sum(n * tier for (_, n), tier in used.items())
        total = sum(n * c for n, c in counts.items())
        assert padded - total <= 0.005 * total + 1024


def test_arrow_sequences(spark, tmp_path):
    rnd = random.Random(2)
    texts = [prose(rnd, rnd.choice([1, 3, 400])) for _ in range(40)] + ODD
    ids = list(range(0, 3 * len(texts), 3))
    rnd.shuffle(ids)
    df = docs_of(spark, texts, ids)
    manifest = arrow_sequences.write_sequences(df, str(tmp_path / "a"), length=64, shard_bytes=4000)
    assert manifest.count() > 2
    got = {r.doc_id: r for r in arrow_sequences.read_sequences(manifest).collect()}
    at = 0
    for d, t in sorted(zip(ids, texts)):
        want = library_ids(t) + [2]
        assert (got[d].start, got[d].n_tokens) == (at, len(want))
        assert got[d].ids_crc32 == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        at += len(want)
    reader = arrow_sequences.open_shard(manifest.orderBy("shard").first()["file"])
    row, mask = arrow_sequences.sequence(reader, 0)
    first = [x for _, t in sorted(zip(ids, texts)) for x in library_ids(t) + [2]][:64]
    assert row.tolist() == first and mask.all() and not row.flags.owndata
    assert arrow_sequences.round_trip(df.limit(0)).count() == 0
    twice = arrow_sequences.round_trip(docs_of(spark, ["b", "a", "c"], [7, 7, None]))
    assert sorted((r.doc_id or -1, r.start) for r in twice.collect()) == [(-1, 0), (7, 2), (7, 4)]


def brute_components(prints, close):
    label = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if close(a, b):
                x, y = label[a], label[b]
                if x != y:
                    for p in prints:
                        if label[p] == max(x, y):
                            label[p] = min(x, y)
    return label


def test_simhash_components(spark):
    rnd = random.Random(4)
    base = [prose(rnd, n) for n in (1, 2, 3, 40, 200, 600)]
    texts = ODD + base * 2
    for b in base[3:]:
        for _ in range(15):
            w = b.split()
            w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash_vp.simhash_components(docs_of(spark, texts)).collect()}

    def fingerprint(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
        if not w:
            return 0
        import xxhash

        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))

    prints = [fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    roots = brute_components(set(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(roots[p], i)
    assert [got[i].component_id for i in range(len(texts))] == [least[roots[p]] for p in prints]
    assert simhash_vp.simhash_components(docs_of(spark, [])).count() == 0
    assert spark.createDataFrame([(1, 42)], "a long, b int").select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == int(__import__("xxhash").xxh64_intdigest(b"a b c", 42))


@pytest.mark.parametrize("radius,words,ratio", [(3, 1, 0.0), (9, 1, 0.8), (24, 2, 0.8)])
def test_tree_search_finds_all_links(radius, words, ratio):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, (40, words), dtype=np.uint64)
    points = centres[rng.integers(0, 40, 1500)].copy()
    for i in range(len(points)):
        for b in rng.integers(0, 64 * words, rng.integers(0, 6)):
            points[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    size = rng.integers(1, 400, len(points))
    every = np.arange(len(points))
    label = simhash_vp.link_shard(points, size, size, every, every, radius, ratio)
    near = simhash_vp.distances(points, points) <= radius
    if ratio:
        near &= (size[:, None] >= ratio * size[None, :]) & (size[None, :] >= ratio * size[:, None])
    seen = np.full(len(points), -1)
    for i in every:
        if seen[i] < 0:
            todo = [i]
            while todo:
                x = todo.pop()
                if seen[x] < 0:
                    seen[x] = i
                    todo += np.flatnonzero(near[x] & (seen < 0)).tolist()
    assert len(set(zip(seen.tolist(), label.tolist()))) == len(set(seen.tolist())) == len(set(label.tolist()))
    tree = simhash_vp.build_tree(points[:400], 16)
    rows, at = simhash_vp.route(tree, points, 0)
    home = dict(zip(rows.tolist(), at.tolist()))
    visits = set(zip(*[x.tolist() for x in simhash_vp.route(tree, points, radius)]))
    assert all((x, home[y]) in visits for x, y in zip(*np.nonzero(simhash_vp.distances(points, points) <= radius)))


def test_one_per_group(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [prose(rnd, n, words) for n in (60, 150, 300, 700)]
    texts = list(base)
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(max(1, len(w) // 90)):
                w[rnd.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    texts += [prose(rnd, rnd.randint(5, 300), words) for _ in range(60)]
    df = docs_of(spark, texts)
    kept = simhash_vp.one_per_group(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(4)) | set(range(28, 88))


def test_one_per_group_counts_repeated_shingles_once(spark):
    rnd = random.Random(19)
    words = [f"w{i}" for i in range(5000)]
    line = " ".join(f"licence{i}" for i in range(14))
    own = [prose(rnd, 300, words) for _ in range(8)]
    texts = ["\n".join([line] * 30 + [t]) for t in own] + ["\n".join([own[0]] + [line] * 3), own[1] + " " + own[1]]
    kept = {r.doc_id for r in simhash_vp.one_per_group(docs_of(spark, texts)).collect()}
    assert kept == set(range(8))
    one, two = own[2] + " " + own[2], " ".join([own[2]] * 3)
    a, b = (simhash_vp.fingerprint(t, 5, 2, distinct=True) for t in (one, two))
    assert a == b and simhash_vp.fingerprint(one, 5, 2) != a


def test_one_per_group_decides_by_jaccard(spark):
    rnd = random.Random(29)
    texts, want, got_at = [], {}, {}

    def pair(n, gone):  # the second lacks the first's last words: similarity 1 - gone / (n - 4)
        a = [f"u{rnd.randrange(10**9)}" for _ in range(n)]
        texts.extend([" ".join(a), " ".join(a[: n - gone])])
        return len(texts) - 1

    for n in (14, 54, 204, 504):
        for _ in range(12):
            want[pair(n, (n - 4) // 5)] = True  # exactly 0.8
            want[pair(n, (n - 4) // 5 + 1)] = False
            want[pair(n, (n - 4) * 3 // 10)] = False
    crowd, base = len(texts), [f"c{i}" for i in range(104)]
    for i in range(40):  # 0.9 to the first, 0.82 to each other; those beyond 30 at 0.74 to all of them
        w = list(base)
        for j in range(1 if i <= 30 else 3):
            w[10 + rnd.randrange(80) if j == 0 else (5, 100)[j - 1]] = f"x{i}.{j}"
        texts.append(" ".join(w))
    kept = {r.doc_id for r in simhash_vp.one_per_group(docs_of(spark, texts)).collect()}
    for i, same in want.items():
        got_at.setdefault(same, []).append(i in kept)
    assert not any(got_at[True]) and all(got_at[False])
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts[crowd:]]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    root = brute_components(range(40), alike)
    assert {i - crowd for i in kept if i >= crowd} == set(root.values())


@pytest.mark.parametrize("stage", ["exact", "near", "leaks"])
def test_filters_tell_rows_with_equal_ids_apart(spark, stage):
    rnd = random.Random(31)
    a, b, c, d, e = (prose(rnd, 100, [f"w{i}" for i in range(4000)]) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, a), (2, c), (2, d), (0, c), (None, None), (None, e), (3, e), (4, b)]
    df = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    if stage == "leaks":
        kept = spaced_seeds.without_leaks(df, spark.createDataFrame([(1, c), (2, a)], "item_id long, text string"))
        want = [(i, t) for i, t in rows if t not in (a, c)]
    else:
        kept = (block_naming.without_duplicates if stage == "exact" else simhash_vp.one_per_group)(df)
        want = [(1, a), (4, b), (0, c), (2, d), (3, e), (None, None)]
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    if stage != "leaks":  # groups of null ids and repeated rows keep one row
        kept = (block_naming.without_duplicates if stage == "exact" else simhash_vp.one_per_group)(docs_of(spark, [a, a, a, b, b], [None, None, None, 7, 7]))
        assert Counter((r.doc_id, r.text, r["at.x"]) for r in kept.collect()) == Counter([(None, a, 1), (7, b, 1)])


def test_host_reputation(spark):
    urls = ["http://A.Example.com/en/1?x", "https://www.example.com/en/2#t", "x://b.net/es/3", "x://bnet/es/3", "x://net/fr/", "no scheme", None, "", "x://?q", "x://h.org", "a://b://c/d",
            "http://example.com/en", "http://notexample.com/en/1", "http://bad.org/en/4\n/z", "http://bad.org/en/5"]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    outcomes = spark.createDataFrame([("bad.org", 200, 190), ("h.org", 300, 3), ("rare.org", 1, 1), ("", 5, 5)], "host string, n long, bad long")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(pages, outcomes, rules).collect()}
    assert got == {
        0: ("a.example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 2: ("b.net", "/es/3", "net/es/", "block"),
        3: ("bnet", "/es/3", None, "allow"), 4: ("net", "/fr/", "net/fr/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("h.org", "", None, "allow"), 10: ("b:", "//c/d", None, "allow"), 11: ("example.com", "/en", "com/", "allow"),
        12: ("notexample.com", "/en/1", "com/", "allow"), 13: ("bad.org", "/en/4\n/z", None, "block"), 14: ("bad.org", "/en/5", None, "block"),
    }
    bounds = {r.host: r.bad_bound for r in host_reputation.bad_bounds(outcomes).collect()}
    assert set(bounds) == {"bad.org", "h.org", "rare.org"} and bounds["bad.org"] > 0.8 > bounds["rare.org"] > bounds["h.org"]
    assert host_reputation.judge(pages.limit(0), outcomes, rules).count() == 0
    # hosts without outcomes have what is known of their domain, else of their suffix
    spread = [(f"h{i}.farm.net", 300, 294 + i % 3) for i in range(6)] + [(f"h{i}.clean.net", 300, i % 3) for i in range(6)]
    spread = spark.createDataFrame(spread, "host string, n long, bad long")
    asked = spark.createDataFrame([(i, f"x://{h}/a") for i, h in enumerate(["new.farm.net", "new.clean.net", "h0.farm.net", "other.net", "else.org", ""])], "page_id long, url string")
    assert [r.verdict for r in sorted(host_reputation.judge(asked, spread).collect())] == ["block", "allow", "block", "allow", "allow", "allow"]
    two = spark.createDataFrame([("a.b.zz", 50, 50), ("c.zz", 50, 0)], "host string, n long, bad long")
    far = {r.host: r.bad_bound for r in host_reputation.bad_bounds(two, suffixes=("b.zz",), hosts=spark.createDataFrame([("x.a.b.zz",), ("y.c.zz",)], "host string")).collect()}
    assert far["x.a.b.zz"] > far["y.c.zz"]
    none = host_reputation.judge(pages, outcomes.limit(0)).collect()
    assert len(none) == len(urls) and {r.verdict for r in none} == {"allow"}


def brute_repeats(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_remove_repeats(spark, seed):
    rnd = random.Random(seed)
    pool = [prose(rnd, 400) for _ in range(4)]
    texts = list(ODD) + ["r " * 60, "r " * 35, "r " * 34]
    for _ in range(60):
        w = rnd.choice(pool).split()
        a = rnd.randrange(300)
        part = w[a : a + rnd.randint(20, 120)]
        if rnd.random() < 0.5:
            part[rnd.randrange(len(part))] = "edit"
        texts.append("\n".join([prose(rnd, rnd.randint(0, 50)), " \t".join(part), prose(rnd, rnd.randint(0, 50))]))
    if seed:
        texts += [pool[0]] * 1100  # anchors shared by so many that they are counted by sums
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_automata.remove_repeats(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    if not seed:
        same = phrase_automata.remove_repeats(docs_of(spark, [pool[0], pool[0], pool[1], pool[2]], [1, 1, 1, None])).collect()
        assert sorted(r.n_removed for r in same) == [0, 0, 400, 400]
        kept = phrase_automata.remove_repeats(docs_of(spark, ["a  b\nc"]), with_text=True).first()
        assert kept.kept_text == "a b c"
        assert phrase_automata.remove_repeats(docs_of(spark, [])).count() == 0


def test_rolling_hash_equals_content():
    ids = ids_of([b"a", b"b", b"a", b"b", b"a", b"c"] * 5, 30)
    h = Rolling(ids).of(4)
    for i in range(len(h)):
        for j in range(len(h)):
            assert (h[i] == h[j]) == (ids[i : i + 4] == ids[j : j + 4]).all()


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_duplicates(spark, block):
    rnd = random.Random(7)
    texts = ODD + ["a b c d e f g", "abcdefg", " a\tbcdefg\n", "abcdefgh", "", "x" * 5000, "xx" * 2500 + " ", "abc", "ABC"]
    texts += ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 12))) for _ in range(80)] + ["hot copy text"] * 60
    rows = block_naming.exact_duplicates(docs_of(spark, texts), block).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for t in texts]
    assert len(rows) == len(texts)
    for r in rows:
        group = [i for i, n in enumerate(norm) if n == norm[r.doc_id]]
        keep = min(group, key=lambda i: (-len(texts[i] or ""), i))
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), keep == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    if block > 3:
        assert block_naming.exact_duplicates(docs_of(spark, [])).count() == 0
        odd = block_naming.exact_duplicates(docs_of(spark, ["a", "a", "a", "b"], [None, 5, 5, 5])).collect()
        assert sorted((r.keep_id, r.group_size, r.kept) for r in odd) == [(5, 1, True), (5, 3, False), (5, 3, True), (5, 3, True)]
        kept = block_naming.without_duplicates(docs_of(spark, ["a", "a ", "b"]))
        assert {r.doc_id for r in kept.collect()} == {1, 2} and kept.columns == docs_of(spark, []).columns


def test_spaced_seeds(spark):
    rnd = random.Random(11)
    words = [f"word{i}" for i in range(2000)]
    items = [prose(rnd, 40, words) for _ in range(6)] + ["tiny exam item", "two words", None, "", "seven words that make one short item"]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(None, "no id " * 20, "x")], "item_id long, text string, h string")
    clean = [prose(rnd, rnd.randint(0, 200), words) for _ in range(30)]
    changed = items[0].split()
    for k in (5, 13, 22, 31):
        changed[k] = "CHANGED"
    texts = clean + [
        "x " + items[0].upper() + ", y", prose(rnd, 30, words) + " " + " ".join(changed), " ".join(items[1].split()[10:25]), " ".join(items[2].split()[:8]),
        "the tiny, exam item.", "seven words that make one short item", items[3] + " and " + items[4], "just two words", None, "",
    ]
    n = len(clean)
    got = {(r.doc_id, r.item_id): r for r in spaced_seeds.overlaps(docs_of(spark, texts), benchmark).collect()}
    assert set(got) == {(n, 0), (n + 1, 0), (n + 2, 1), (n + 4, 6), (n + 5, 10), (n + 6, 3), (n + 6, 4)}
    assert (got[n, 0].n_words, got[n, 0].n_equal, got[n, 0].doc_start) == (40, 40, 1)
    assert (got[n + 1, 0].n_words, got[n + 1, 0].n_equal, got[n + 1, 0].doc_start) == (40, 36, 30)
    assert (got[n + 2, 1].n_words, got[n + 2, 1].item_start) == (15, 10)
    kept = spaced_seeds.without_leaks(docs_of(spark, texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    short = spaced_seeds.overlaps(docs_of(spark, texts), benchmark, shortest=2).collect()
    assert {(r.doc_id, r.item_id) for r in short} - set(got) == {(n + 7, 7)}
    assert spaced_seeds.overlaps(docs_of(spark, []), benchmark).count() == 0
    assert spaced_seeds.overlaps(docs_of(spark, texts), benchmark.limit(0)).count() == 0


def test_masks_are_lossless():
    import itertools

    def found(n, masks, bad):
        return any(all(m[i] == "0" or at + i not in bad for i in range(len(m))) for m in masks for at in range(n - len(m) + 1))

    for n in range(12, 24):  # a longer stretch has a part of such a length with the same share
        assert all(found(n, spaced_seeds.MASKS, bad) for bad in itertools.combinations(range(n), n // 5)), n
    for n, masks in spaced_seeds.SHORT_MASKS.items():
        assert all(found(n, masks, bad) for bad in itertools.combinations(range(n), n // 5)), n


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(41)
    words = [f"w{i}" for i in range(400)]
    items = [[rnd.choice(words) for _ in range(n)] for n in [*range(3, 32), 45, 60]]
    texts = []
    for item in items:
        n = len(item)
        for _ in range(6):
            size = n if n <= 12 else rnd.randint(12, n)
            a = rnd.randint(0, n - size)
            part = item[a : a + size]
            for k in rnd.sample(range(n) if n <= 12 else range(1, size - 1), size // 5):  # ends of short items too
                part[k] = "other"
            texts.append([rnd.choice(words) for _ in range(rnd.randint(0, 25))] + part + [rnd.choice(words) for _ in range(rnd.randint(0, 25))])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = spaced_seeds.overlaps(docs_of(spark, [" ".join(t) for t in texts]), benchmark).collect()
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_equal, -r.doc_start, r.item_start) for r in rows}
    number = {w: i for i, w in enumerate([*words, "other"])}
    docs, asked = ([np.array([number[w] for w in x], dtype=np.uint64) for x in xs] for xs in (texts, items))
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(asked):
            least = min(12, len(item))
            for shift in range(least - len(item), len(doc) - least + 1):
                lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
                equal = int((doc[lo + shift : hi + shift] == item[lo:hi]).sum())
                if equal >= 0.8 * least:
                    b = spaced_seeds.best_stretch(doc, item, shift, least, 0.8) if len(item) > 12 else (0, len(item), equal)
                    if b:
                        want[d, i] = max(want.get((d, i), ()), (b[1], b[2], -(b[0] + shift), b[0]))
    assert got == want and len(want) >= len(texts)


def test_best_stretch_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        doc, item = (np.array([rnd.randint(0, 2) for _ in range(n)], dtype=np.uint64) for n in (30, 20))
        shift, least = rnd.randint(-15, 25), rnd.randint(1, 8)
        best = 0
        for a in range(20):
            for b in range(a + least, 21):
                if 0 <= a + shift and b + shift <= 30:
                    e = doc[a + shift : b + shift] == item[a:b]
                    if e[0] and e[-1] and e.sum() >= 0.8 * (b - a) - 1e-9:
                        best = max(best, b - a)
        got = spaced_seeds.best_stretch(doc, item, shift, least, 0.8)
        assert (got[1] if got else 0) == best


def test_encoder_is_shared():
    assert encoder(vocabulary()) is encoder(vocabulary())
