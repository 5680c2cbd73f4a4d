"""Vector codes, the positional index and the conversation trie on small awkward tables, each against a plain restatement."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hard import CLASHES, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from creditloom.llm import positional, prefixtrie, vectorcode

NONE = hashlib.sha256(b"").hexdigest()


# operator 11


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(0, 5), st.integers(0, 2**32 - 1), st.sampled_from([3, 200, 1 << 24]))
def test_masks_find_the_first_of_the_nearest_entries(entries, dims, seed, span):
    rng = np.random.default_rng(seed)
    book = rng.integers(-span, span + 1, (entries, dims))
    x = rng.integers(-span - 2, span + 3, (50, dims))
    entry, d = vectorcode.Slices(book).nearest(x)
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert entry.tolist() == far.argmin(axis=1).tolist() and d.tolist() == far.min(axis=1).tolist()


def test_candidates_are_the_entries_in_the_box():
    rng = np.random.default_rng(3)
    book, x = rng.integers(-9, 10, (64, 3)), rng.integers(-12, 13, (80, 3))
    radius = rng.integers(0, 8, 80)
    got = vectorcode.Slices(book).candidates(x, radius)
    inside = (np.abs(x[:, None] - book[None]) <= radius[:, None, None]).all(axis=2)
    assert got.tolist() == [sum(1 << int(e) for e in np.flatnonzero(r)) for r in inside]


def test_huge_components_are_whole_numbers():
    x = vectorcode.whole(np.array([[1e300, -1.5, 3e307, 0.001]]))
    assert [int(v) for v in x[0]] == [int(1e300 * 256), -384, int(3e307) * 256, 0]
    book = np.array([[10**40, 0], [0, 0]], dtype=object)
    entry, d = vectorcode.Slices(book).nearest(np.array([[10**40 - 3, 4], [1, 1]], dtype=object))
    assert entry.tolist() == [0, 1] and d.tolist() == [25, 2]


def plain_codes(rows, parts=16):
    kept = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(((i, v) for i, v, _ in kept if i is not None), key=lambda r: r)[:64]
    if not seeds:
        return Counter()
    w = len(seeds[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(v)[p] for _, v in seeds if len(v) == parts * w] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))
    whole = [(i, cut(v), k) for i, v, k in kept if len(v) == parts * w]
    for _ in range(2):
        new = []
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in whole:
                groups[near(p, v[p])[1]].append(v[p])
            new.append([[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else e for n, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded, sums = [], {}
    for i, v, k in whole:
        found = [near(p, v[p]) for p in range(parts)]
        coded.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), k))
    for _, _, d, k in coded:
        sums[k] = sums.get(k, 0) + d
    other = [(i, None, None, k) for i, v, k in kept if len(v) != parts * w]
    return Counter((i, c, d, sums.get(k), digest) for i, c, d, k in coded + other)


def vector_rows(n):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([0, 1, 1, 1, None])) for i in rng.sample(range(10 * n), n)]
    rows += [(rows[0][0], rows[0][1], 1)] * 2 + [(None, rows[1][1], 2), (None, None, 2), (3, None, 1)]
    rows += [(4, rows[2][1][:31] + [None], 1), (5, rows[2][1][:31] + [math.nan], 1), (6, rows[2][1][:31] + [-math.inf], 1)]
    return rows + [(10 * n, [0.5] * 16, 3), (10 * n + 1, [], 3), (10 * n + 2, [0.0] * 32, None), (-7, [1000.25] * 32, 9)]


@pytest.mark.parametrize("n", [5, 200])
def test_codes_equal_plain_codes(spark, n):
    rows = vector_rows(n)
    df = spark.createDataFrame([(*r, *["x"] * len(CLASHES), "c", "e") for r in rows], "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{c}` string" for c in [*CLASHES, "code", "error"])).repartition(5)
    got = vectorcode.compressed(df)
    assert Counter(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == plain_codes(rows)


def test_no_usable_vector_gives_no_rows(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vectorcode.compressed(empty).collect() == [] and vectorcode.compressed(empty.limit(0)).collect() == []


# operator 12


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items, width=10):
    windows = defaultdict(set)
    for name, text in items:
        w = terms(text)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, names = terms(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    names |= got
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def plain_near(docs, items, width, within):
    out = set()
    for i, text in docs:
        w = terms(text)
        for name, other in items:
            own = terms(other)
            n = min(width, len(own))
            for s in range(len(own) - n + 1 if own else 0):
                if any(set(own[s : s + n]) <= set(w[a : a + within]) for a in range(len(w))):
                    out.add((i, name))
    return out


def leaks():
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randrange(10, 50), 40)) for i in range(12)]
    items += [(12, "Short one, twice."), (13, ""), (14, None), (15, "..!"), (None, items[0][1]), (3, "é Ünïcode wörds \U0001F600"), (16, "the"), (17, "the the the"), (18, prose(rng, 10, 40))]
    docs = [(i, prose(rng, rng.randrange(0, 200), 40)) for i in range(30)]
    docs += [(100 + i, prose(rng, 20, 40) + "\n" + t.upper().replace(" ", " , ") + "! " + prose(rng, 5, 40)) for i, (_, t) in enumerate(items[:8])]
    docs += [(200, items[1][1][: len(items[1][1]) // 2]), (201, "the " * 40), (202, "short ONE"), (203, "twice short one twice short one twice"), (204, None), (205, ""), (None, items[4][1]), (200, items[5][1])]
    # the last words of one document and the first of the next make no phrase
    half = items[2][1].split(" ")
    docs += [(300, " ".join(half[:5])), (301, " ".join(half[5:10])), (302, "é ünïcode WÖRDS\x00wörds \U0001F600"), (303, prose(rng, 30_000, 40) + " " + items[6][1])]
    return docs, items


def frame(spark, rows, key):
    kinds = ", ".join(f"`{c}` string" for c in [*CLASHES, "term", "words", "block", "row", "spans", "iid"])
    return spark.createDataFrame([(*r, *["x"] * (len(CLASHES) + 6)) for r in rows], f"{key} long, text string, {kinds}").repartition(3)


@given(st.lists(st.integers(0, 2**35 - 1)))
def test_gaps_come_back(values):
    data, size = positional.packed(np.array(values, dtype=np.int64))
    assert positional.unpacked(data).tolist() == values and size.sum() == len(data)


@pytest.mark.parametrize("chunk", [1 << 19, 64])
def test_hits_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(positional, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(positional, "STEP", 257)
    docs, items = leaks()
    got = positional.contaminated(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"))
    assert Counter(map(tuple, got.collect())) == plain_hits(docs, items)


@pytest.mark.parametrize(("width", "within"), [(4, 4), (4, 7), (10, 14)])
def test_near_words_equal_brute_force(spark, width, within):
    docs, items = leaks()
    docs = [(k, t) for k, (_, t) in enumerate(docs) if len(t or "") < 5_000]
    items = [(k, t) for k, (_, t) in enumerate(items)]
    index, listed = positional.build_index(frame(spark, docs, "doc_id")), positional.items_of(frame(spark, items, "item_id"))
    got = positional.matches(index, listed, width, within).selectExpr("block", "row", "explode(items) AS iid")
    named = got.join(positional.documents_of(index), ["block", "row"]).join(listed, "iid").select("doc_id", "item_id")
    assert {tuple(r) for r in named.collect()} == plain_near(docs, items, width, within)


def test_index_and_items_may_be_empty(spark):
    docs, items = leaks()
    nothing = lambda key: frame(spark, [(1, "x")], key).limit(0)
    assert positional.contaminated(nothing("doc_id"), frame(spark, items, "item_id")).collect() == []
    clean = positional.contaminated(frame(spark, docs, "doc_id"), nothing("item_id")).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean) and {r.items_sha256 for r in clean} == {NONE}


# operator 13


def grown(keys):
    root = prefixtrie.Node(b"")
    for row, key in enumerate(keys):
        prefixtrie.insert(root, key, row)
    return root


def found(root, key):
    node, at = root, 0
    while True:
        if key[at : at + len(node.path)] != node.path:
            return -1
        at += len(node.path)
        if at == len(key):
            return node.end
        node = node.get(key[at])
        if node is None:
            return -1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=6), unique=True), st.lists(st.binary(min_size=0, max_size=6)))
def test_tree_holds_its_keys_only(keys, others):
    root = grown(keys)
    rows = {k: i for i, k in enumerate(keys)}
    assert all(found(root, k) == rows.get(k, -1) for k in [*keys, *others])
    ends = [n.end for n, _, _ in prefixtrie.postorder(root) if n.end >= 0]
    assert sorted(ends) == list(range(len(keys)))
    assert all(n is root or n.end >= 0 or len(n.ordered()) > 1 for n, _, _ in prefixtrie.postorder(root))


def test_layouts_grow_and_keep_order():
    sizes = []
    for n in (1, 4, 5, 16, 17, 48, 49, 256):
        order = list(range(n))
        random.Random(n).shuffle(order)
        root = grown([bytes([b]) + b"tail" for b in order])
        sizes.append(root.size)
        assert [c.path[0] for c in root.ordered()] == list(range(n)) and all(c.path[1:] == b"tail" for c in root.ordered())
    assert sizes == [4, 4, 16, 16, 48, 48, 256, 256]


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append((turn is not None, turn or 0, name, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    members, whole = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        cost = (len(m) - 1) * (len(p[-1][1]) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += cost
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if whole[c] == p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def talks():
    rng = random.Random(2)
    say = [prose(rng, 3, 30) for _ in range(6)]
    rows = []
    for c in [*range(0, 60), *range(100, 160), *range(250, 290), -3, -100, -205]:
        start = [("system", "common")] if c % 3 else []
        own = start + [(rng.choice(["user", "assistant", None]), rng.choice([*say, None, ""])) for _ in range(rng.randrange(0, 7))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(own or [(None, None)])]
    rows += [(400 + c, t, "user", "same") for c in range(40) for t in range(3)]  # copies
    rows += [(600, t, "user", f"long {t}") for t in range(300)] + [(601 + k, t, "user", f"long {t}") for k in range(3) for t in range(150 * k)]
    rows += [(700, None, "user", "first"), (700, 0, "user", "second"), (700, 0, "user", "second"), (700, 0, "assistant", "third"), (None, 0, "user", "lost"), (701, -5, "x" * 9, "y" * 70_000), (702, 1, "é", "\U0001F600")]
    return rows


def turns_frame(spark, rows):
    more = [*CLASHES, "key", "chars", "depth", "part", "node", "parent"]
    return spark.createDataFrame([(*r, *["x"] * len(more)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in more)).repartition(4)


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
def test_nodes_equal_brute_force(spark, ranges):
    rows = talks()
    got = prefixtrie.trie(turns_frame(spark, rows), ranges)
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert Counter(map(tuple, got.select(columns).collect())) == plain_trie(rows)


def test_ids_stream_through_the_hash_over_batches():
    rows = [(b"a", 1), (b"a", 5), (b"a", 9), (b"b", 2), (b"c", -4), (b"c", 30)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.binary()), pa.array([i for _, i in part], pa.int64())], ["digest", "conv_id"])
    for cut in range(len(rows) + 1):
        got = [tuple(r.values()) for b in prefixtrie._hashed(iter([batch(rows[:cut]), batch(rows[cut:])])) for r in b.to_pylist()]
        assert got == [(d, len(i), min(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for d, i in ((b"a", [1, 5, 9]), (b"b", [2]), (b"c", [-4, 30]))]


def test_no_conversation_no_node(spark):
    assert prefixtrie.trie(turns_frame(spark, [(None, 0, "user", "lost")])).collect() == []
    assert prefixtrie.trie(turns_frame(spark, talks()).limit(0)).collect() == []

