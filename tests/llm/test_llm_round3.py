"""Operators 11 to 13 against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from skymill.llm import bottom_k, coordinate_pruning, structure_repair

DOCS = "doc_id long, text string, row string, n int, root long, value string"


def sets_of(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def smallest_reachable(ids, links):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(ids))]


def brute_components(ids, texts, width=2, percent=80):
    sets = sets_of(texts, width)
    links = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], smallest_reachable(ids, links)


def varied(rng, base, share):
    return " ".join(rng.choice("qwxyz") * rng.randint(1, 9) if rng.random() < share else w for w in base.split())


def test_bottom_k_components_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    frame = " ".join(rng.choices(words[:20], k=40))  # a passage that many documents share
    texts = [None, "", " \t", "One", "one", "One two", "one  TWO", "one two three"]
    for size in (6, 30, 90, 400):
        base = " ".join(rng.choices(words, k=size))
        texts += [base, base.upper(), base.replace(" ", "\n\t")] + [varied(rng, base, s) for s in (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.2)]
    texts += [frame + " " + " ".join(rng.choices(words, k=rng.choice((3, 8, 12)))) for _ in range(40)]
    ids = [None if i % 11 == 3 else i for i in range(len(texts))]
    ids[20] = ids[21]
    df = spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in zip(ids, texts)], DOCS)
    got = bottom_k.near_duplicates(df.repartition(5)).collect()
    n, component = brute_components(ids, texts)
    want = sorted(((d, k, c, d == c) for d, k, c in zip(ids, n, component)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert bottom_k.near_duplicates(df.limit(0)).count() == 0


def test_bottom_k_crowd_joins_without_pairs(spark):
    """A crowd of copies proposes about as many pairs as it has list entries, not its square."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    texts = [varied(rng, base, 0.03) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bottom_k.sketch(df, 2)
    nodes = rows.selectExpr("row AS node", "n", "sketch")
    entries = bottom_k.lists(nodes, 80)
    assert entries.groupBy("node").count().agg({"count": "max"}).first()[0] <= 2 * bottom_k.K
    assert [r.component_id for r in sorted(bottom_k.near_duplicates(df).collect())] == brute_components(list(range(400)), texts)[1]


def test_bottom_k_crowd_below_the_limit_is_told_apart_without_pairs(spark, monkeypatch):
    """Of a crowd close below the limit few pairs are written and compared on the sets, and no link is lost."""
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    texts = [varied(rng, base, 0.045) for _ in range(300)]
    handed, verified = [], bottom_k.verified

    def counted(pairs, sets, percent):
        handed.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(bottom_k, "verified", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.component_id for r in sorted(bottom_k.near_duplicates(df).collect())]
    assert got == brute_components(list(range(300)), texts)[1]
    assert len(handed) == 2 and handed[1] < 1500, handed


def test_bottom_k_makes_each_whole_set_once(spark, monkeypatch, tmp_path):
    """The filter on the digests doesn't shingle the texts again, in a second worker beside the first."""
    log, shingles_of = str(tmp_path / "calls"), bottom_k.shingles_of

    def logged(text, width):
        with open(log, "a") as f:
            f.write("x\n")
        return shingles_of(text, width)

    df = spark.createDataFrame([(i, f"a{i} b c d{i}") for i in range(20)], "doc_id long, text string")
    nodes = bottom_k.cut(bottom_k.sketch(df, 2).selectExpr("row AS node", "key", "d0", "d1"))
    monkeypatch.setattr(bottom_k, "shingles_of", logged)
    assert bottom_k.whole_sets(df, nodes, 2).count() == 20
    assert len(open(log).readlines()) == 20


def test_bottom_k_marks_never_tell_too_much():
    rng = np.random.default_rng(11)
    for size in (3, 100, 5000):
        a = rng.integers(-(2**63), 2**63, size)
        b = np.concatenate([a[: size // 2], rng.integers(-(2**63), 2**63, size // 3)])
        differ = np.bitwise_count((bottom_k.marks_of(a) ^ bottom_k.marks_of(b)).view(np.uint64)).sum()
        assert len(bottom_k.marks_of(a)) * 64 == bottom_k.MARKS and differ <= len(np.setxor1d(a, b))
        assert not (bottom_k.marks_of(a) ^ bottom_k.marks_of(a[::-1])).any()


def test_bottom_k_prefix_meets_every_similar_pair():
    """The number of values that must be shared, on random pairs at the asked similarity."""
    rng = np.random.default_rng(1)
    k, least = bottom_k.K, bottom_k.shared_at_least(80)
    assert 20 <= least <= 30
    for _ in range(2000):
        union = int(rng.integers(10, 2000))
        values = rng.permutation(union)
        common = -(-union * 4 // 5)
        extra = rng.random(union - common) < 0.5
        a, b = np.concatenate([values[:common], values[common:][extra]]), np.concatenate([values[:common], values[common:][~extra]])
        n = min(len(a), len(b))
        needed = min(-(-n * 4 // 5), k - n // 4) if n <= k else max(k - n // 4, least)
        assert len(set(np.sort(a)[:k]) & set(np.sort(b)[:k])) >= needed


def brute_negatives(rows, positives=5, negatives=10):
    """rows: (vec_id, vector or None, label or None), in order."""
    take = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda s, r: (-s[r], take[r][0] is None, take[r][0] or 0)
    out = []
    for a, (i, label, v) in enumerate(take):
        if i is None or i % 100:
            continue
        s = [sum(x * y for x, y in zip(v, w)) for _, _, w in take]
        for p in sorted((r for r in range(len(take)) if r != a and take[r][1] == label), key=lambda r: order(s, r))[:positives]:
            fit = [r for r in range(len(take)) if take[r][1] != label and 30 * s[p] <= 100 * s[r] <= 90 * s[p]]
            out += [(i, take[p][0], k + 1, take[r][0], s[p], s[r]) for k, r in enumerate(sorted(fit, key=lambda r: order(s, r))[:negatives])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16, 4096])
def test_coordinate_pruning_against_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(coordinate_pruning, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.01, 0.3, 1, 4])).astype("float32").tolist(), int(rng.choice(4, p=[0.5, 0.3, 0.1, 0.1]))) for i in range(700)]
    rows[100] = (100, [0.0] * 8, 1)
    rows[201], rows[203], rows[205], rows[207] = (201, None, 1), (203, [float("nan")] * 8, 1), (205, rows[205][1], None), (207, [None] + [1.0] * 7, 2)
    rows[209], rows[211], rows[213] = (209, [float("inf")] * 8, 0), (None, rows[212][1], 0), (213, [], 1)
    rows[300] = (300, rows[301][1], rows[301][2])
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, row int, block string")
    got = coordinate_pruning.hard_negatives(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_negatives(rows)
    assert coordinate_pruning.hard_negatives(df.limit(0)).count() == 0


def test_coordinate_pruning_leaves_no_reachable_row_out_and_prunes():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(3000, 16)) * 200)
    v[:50] = np.floor(v[0] + rng.normal(size=(50, 16)) * 30)
    v = np.floor(v / np.sqrt((v * v).sum(axis=1))[:, None] * rng.uniform(900, 1000, size=(3000, 1)))  # one bucket of lengths
    block = coordinate_pruning.Block(np.arange(3000), np.arange(3000), v)
    for q in v[:40]:
        scores = block.vectors @ q
        for least in (0.3, 0.6, 0.9):
            got = block.candidates(q, least * (q @ q))
            assert set(np.flatnonzero(scores >= least * (q @ q))) <= set(got.tolist())
        assert len(got) < 1000


def test_scores_beyond_floats_are_exact():
    big = float(2**40)
    block = coordinate_pruning.Block(np.arange(2), np.arange(2), np.array([[big + 1, 1.0], [big, 3.0]]))
    assert block.scores(np.array([1000.0, 1.0]), np.arange(2)) == [1000 * (2**40 + 1) + 1, 1000 * 2**40 + 3]
    assert block.scores(np.array([big, big]), np.arange(2)) == [2**63 - 1] * 2


def brute_repair(rows, costs):
    """Dijkstra over (cost, audit); rows are (role, text)."""
    seen, faults = set(), []
    for r in rows:
        text = r[1].strip(" \t\n\x0b\f\r")
        faults.append("blank" if not text else "duplicate" if r in seen else "truncated" if text[-1] not in ".!?" else "")
        seen.add(r)
    illegal = sum((a[0][:1] or "-") + (b[0][:1] or "-") not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done, limit = [(0, "", 0, "", ())], set(), 2 * len(rows) + 2
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
            return *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest
        if (audit, i, state) in done or len(audit) > limit:
            continue
        done.add((audit, i, state))
        made = [(c, role) for c, role in (("u", "user"), ("a", "assistant")) if (state, c) in after]
        for c, role in made:
            heapq.heappush(heap, (cost + costs.insert, audit + "I", i, after[state, c], (*out, f"{role}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + costs.delete, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                extra = costs.truncated if faults[i] else 0
                if (state, role[:1]) in after:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, after[state, role[:1]], (*out, f"{role}:{text}")))
                for c, role in made:
                    heapq.heappush(heap, (cost + extra + costs.rerole, audit + "R", i + 1, after[state, c], (*out, f"{role}:{text}")))


TURNS = "conv_id long, turn long, role string, text string, copy int"
ROLES = ["user", "assistant", "system", "tool", "", "u2"]
SAID = ["Yes.", "No!", "Why?", "cut", "", "  ", "end. \n"]


@pytest.mark.parametrize("costs", [structure_repair.Costs(), structure_repair.Costs(insert=1), structure_repair.Costs(2, 3, 2, 1)])
def test_repair_against_shortest_paths(spark, monkeypatch, costs):
    monkeypatch.setattr(structure_repair, "SLICE", 3)  # conversations of several slices
    rng = random.Random(costs.insert)
    data = {c: [(t, rng.choice(ROLES[: rng.choice((2, 3, 6))]), rng.choice(SAID)) for t in range(rng.randint(1, 7))] for c in range(60)}
    df = spark.createDataFrame([(c, *r, 0) for c, rows in data.items() for r in rows], TURNS)
    got = {r.conv_id: r for r in structure_repair.repair(df.repartition(7), df, costs).collect()}
    inserted = 0
    for c, rows in data.items():
        r = got[c]
        want = brute_repair([x[1:] for x in rows], costs)
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want, (c, rows)
        inserted += r.audit.count("I")
    assert (inserted > 0) == (costs.insert < 5)


def test_damage_nulls_gaps_and_lost_conversations(spark):
    kind = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    lost = next(c for c in range(1000) if kind(c, 0) == 0)
    rows = [(lost, 0, "user", "Gone."), (None, None, None, None), (None, 5, "user", "Hi there."), (None, 6, "assistant", "Hello.")]
    rows += [(2000 + c, t, r, "Said so. Right!") for c in range(60) for t, r in ((0, "system"), (1, "user"), (4, "assistant"), (4, "assistant"))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, _c int")
    got = {r.conv_id: r for r in structure_repair.damage_and_repair(df).collect()}
    after = {}
    for c, t, role, text in rows:
        kept, k = after.setdefault(c, []), kind(c, t)
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(t, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    assert set(got) == set(after)
    for c, kept in after.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (gaps, *brute_repair([x[1:] for x in kept], structure_repair.Costs())), c
    assert got[lost].audit == "" and got[lost].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert structure_repair.damage_and_repair(df.limit(0)).count() == 0


def test_scalars_order_by_cost_then_letters():
    audits = ["", "D", "DI", "DK", "I", "ID", "K", "KK", "R"]
    weights = [structure_repair.scalar(c, a, 2) for c in (0, 1) for a in audits]
    assert weights == sorted(weights)
    assert [structure_repair.read(w, 2) for w in weights] == [(c, a) for c in (0, 1) for a in audits]
