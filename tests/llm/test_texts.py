"""Corpus operators on small awkward tables, each against a plain restatement."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from hard import prose, table, texts, words
from tokenizers import Tokenizer

from creditloom.llm import common, fertility, linerun, packing, pieces, ppm, probminhash, toxicity, weaklabel

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def multiset(df):
    return Counter(map(tuple, df.collect()))


# operator 1


@pytest.fixture(scope="module")
def model():
    return pieces.load(PIECES)


def test_trie_holds_its_keys_only():
    keys = {b"a": 0, b"ab": 1, b"abc": 2, b"b\xff": 3, b"\x00": 4}
    trie = pieces.DoubleArray.build(keys)
    data = np.frombuffer(b"abcab\xff\x00", dtype=np.uint8)
    row, end, piece = pieces.matches(trie, data, np.arange(len(data)), np.full(len(data), len(data)))
    expected = {(i, i + len(k), n) for k, n in keys.items() for i in range(len(data)) if data.tobytes()[i : i + len(k)] == k}
    assert set(zip(row.tolist(), end.tolist(), piece.tolist(), strict=True)) == expected


def best_score(text: str, held: dict[str, float], unknown: float) -> float:
    text = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(len(text), i + 16) + 1):
            if text[i:j] in held:
                best[j] = max(best[j], best[i] + held[text[i:j]])
                single |= j == i + 1
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


def test_pieces_have_the_best_score_and_decode(spark, model):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    held = {lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    assert max(map(len, held)) <= 16
    got = pieces.tokenise(table(spark), PIECES).collect()
    assert len(got) == len(texts())
    by_text = {t: None for _, t in texts()}
    assert Counter(r.decoded for r in got) == Counter((t or "") for _, t in texts())
    for r in got:
        if r.decoded and len(r.decoded) < 3000:
            assert r.decoded in by_text
            assert math.isclose(r.score, best_score(r.decoded, held, model.unknown), rel_tol=1e-6)
        assert r.n_byte_pieces == sum(lib.is_byte(i) for i in r.ids)
        if not r.decoded:
            assert r.ids == [] and r.n_pieces == 0 and r.score == 0


def test_decode_joins_bytes_and_replaces_bad_ones(model):
    ids = np.array([int(model.byte_ids[b]) for b in "é".encode() + b"\xff"])
    assert pieces.decode(ids, np.array([2, 1, 0]), model).to_pylist() == ["é", "�", ""]


# operator 2


def plain_figures(text):
    own = words(text)
    windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    inside = {i + k for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        again += bool(words(line)) and line in seen
        seen.add(line)
    tokens = [i for w in own for i in packing.encoder(BYTES).encode_ordinary(" " + w)]
    times, n = Counter(tokens), max(1, len(tokens))
    entropy = -sum(c / n * math.log2(c / n) for c in times.values()) / max(1.0, math.log2(min(n, 50256)))
    chars = sum(map(len, own))
    return len(own), chars, sum(c in "#*$%&|<>" for c in text or ""), again, len(inside), len(tokens), round(chars / n, 9), round(entropy, 9)


def test_rules_count_like_the_plain_version(spark):
    got = fertility.quality_rules(table(spark), BYTES, PIECES).collect()
    mine = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.byte_tokens, round(r.byte_fertility, 9), round(r.byte_entropy, 9)) for r in got)
    assert mine == Counter((i, *plain_figures(t)) for i, t in texts())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.outside)
    assert any(r.kept for r in got)


def test_bands_reject_a_text_unlike_its_language(spark):
    import random

    rng = random.Random(1)
    rows = [(i, prose(rng, 200)) for i in range(40)] + [(99, " ".join(f"{rng.getrandbits(60):x}%{i}" for i in range(120)))]
    got = {r.doc_id: r for r in fertility.quality_rules(table(spark, rows), BYTES, PIECES).collect()}
    assert not got[99].kept and not got[99].base_failed and "byte_fertility" in got[99].outside
    assert all(r.kept for i, r in got.items() if i != 99)
    assert fertility.keep_passing(table(spark, rows), BYTES, PIECES).count() == 40


# operator 3


def plain_lines(rows, least=50):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        drop = [False] * len(lines)
        for p in range(len(lines)):
            total = 0
            for q in range(p, len(lines)) if words(lines[p]) else ():
                total += len(words(lines[q]))
                if total >= least:
                    run = tuple(lines[p : q + 1])
                    if run in seen:
                        drop[p : q + 1] = [True] * (q + 1 - p)
                    seen.add(run)
                    break
        left = [x for x, d in zip(lines, drop, strict=True) if not d]
        out.append((rows[k][0], None if rows[k][1] is None or not left else "\n".join(left), len(lines), sum(drop)))
    return Counter(out)


def test_runs_go_but_for_their_first_copy(spark):
    done = linerun.dedup_lines(table(spark)).select("doc.doc_id", "doc.text", "n_lines", "n_deleted")
    assert multiset(done) == plain_lines(texts())
    assert linerun.dedup_lines(table(spark)).select("doc.*").columns == table(spark).columns


def test_lines_are_cut_once_and_documents_are_not_sorted(spark):
    plan = linerun.keep_new_lines(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "SortMergeJoin" not in plan
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_totals_of_parts_need_no_python_workers(spark):
    rows = spark.range(7).selectExpr("id", "2L AS n")
    done = common.running_start(rows, ["id"], "n")
    assert "Scan ExistingRDD" not in done._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.start) for r in done.collect()} == {(i, 2 * i) for i in range(7)}
    assert common.running_start(rows.where("id < 0"), ["id"], "n").collect() == []


def test_short_lines_many_times_and_overlapping_runs(spark):
    rows = [(i, "\n".join(["a b c"] * n + [f"own {i}"] * (i % 2))) for i, n in enumerate([1, 17, 40, 18, 200, 35])]
    assert multiset(linerun.dedup_lines(table(spark, rows)).select("doc.doc_id", "doc.text", "n_lines", "n_deleted")) == plain_lines(rows)


def every_repeated_line(rows, least=50):
    """Each line of any run of at least ``least`` words that also stands earlier."""
    first, found = {}, []
    for k, (_, text) in enumerate(rows):
        lines = text.split("\n")
        counts = [len(words(x)) for x in lines]
        drop = [False] * len(lines)
        for p in range(len(lines)):
            for q in range(p, len(lines)):
                if sum(counts[p : q + 1]) >= least and first.setdefault(tuple(lines[p : q + 1]), (k, p)) < (k, p):
                    drop[p : q + 1] = [True] * (q + 1 - p)
        left = [x for x, d in zip(lines, drop, strict=True) if not d]
        found.append((rows[k][0], "\n".join(left) if left else None, len(lines), sum(drop)))
    return Counter(found)


def test_runs_go_to_their_last_line(spark):
    rng = random.Random(11)

    def lines(*counts):
        return [" ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) for n in counts]

    two, five, blank, long_ = lines(60, 10), lines(12, 30, 9, 20, 5), ["", *lines(55), "", ""], lines(50, *[1] * 40, 30, 0, 15, 3)
    rows = [["own a", *two], two, [*two, "own b"], five, ["own c", *five, "own d"], blank, ["own e", *blank, "own f"], long_, [*long_[:20], "own g"], ["own h", *long_[3:], *long_]]
    pool = lines(*[rng.randrange(0, 40) for _ in range(12)])
    rows += [[x for _ in range(5) for at in [rng.randrange(12)] for x in pool[at : at + rng.randrange(1, 6)]] for _ in range(30)]
    rows = [(i, "\n".join(x)) for i, x in enumerate(rows)]
    expected = every_repeated_line(rows)
    assert (1, None, 2, 2) in expected and (4, "own c\nown d", 7, 5) in expected
    assert multiset(linerun.dedup_lines(table(spark, rows)).select("doc.doc_id", "doc.text", "n_lines", "n_deleted")) == expected


# operator 4


def test_ids_equal_the_library_and_pieces_cover_each_text(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", " <|endoftext|>\n\n<|endoftext", "wide\u3000<|endoftext|>\u3000 <|endoftext|> "]
    rows = [*texts(), *((60 + i, t) for i, t in enumerate(special))]
    assert lib.encode(special[0], add_special_tokens=False).ids.count(50256) == 1
    got = packing.pack(table(spark, rows), BYTES, limit=64).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.bucket == int(math.log2(r.length)) for r in got)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    expected = defaultdict(Counter)
    for i, t in rows:
        expected[i][tuple(lib.encode(t or "", add_special_tokens=False).ids) + (0,)] += 1
    for i, own in by_doc.items():
        found = Counter()
        own.sort(key=lambda r: r.sequence_id)
        current = []
        for r in own:
            assert r.start == len(current) % r.doc_tokens
            current += np.frombuffer(r.ids, dtype="<u4").tolist()
            if len(current) == r.doc_tokens:
                found[tuple(current)] += 1
                current = []
        assert found == expected[i]
    assert [r.ids_crc32 for r in packing.digests(packing.pack(table(spark, [(1, None)]), BYTES)).collect()] == [packing.crc32_of([0])]


@pytest.mark.parametrize("n, expected", [(1, [1]), (63, [32, 16, 8, 4, 2, 1]), (200, [64, 64, 64, 8])])
def test_lengths_are_binary_digits(n, expected):
    lengths, count = packing.binary_lengths(np.array([n]), 64)
    assert lengths.tolist() == expected and count.tolist() == [len(expected)]


# operator 5


def plain_items(text):
    own = words(text)
    return Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else Counter()


def plain_similarity(a, b):
    if {*a.values(), *b.values()} == {1}:
        return len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a if d in b)


def test_probability_jaccard_and_its_estimate():
    a, b = "p q r s t u v w x y z " * 3 + "k l m n o", "p q r s t u v w x y z " * 2 + "k l m n o h"
    flat, n = probminhash.packed(pa.array([a, b]))
    exact = probminhash.probability_jaccard(flat[: n[0]], flat[n[0] :])
    assert math.isclose(exact, plain_similarity(plain_items(a), plain_items(b)))
    row, item, times = probminhash.shingles(pa.array([a, b]))
    signature = probminhash.signatures(row, item, times.astype(float), 2, 8192)
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.03


def plain_classes(rows):
    items = [plain_items(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if items[x] and items[y] and items[x] & items[y] and plain_similarity(items[x], items[y]) >= 0.8:
                parent[root(x)] = root(y)
    lowest = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        lowest[root(k)].append(i)
    out = Counter()
    for k, (i, _) in enumerate(rows):
        ids = [x for x in lowest[root(k)] if x is not None]
        low = min(ids) if ids else None
        out[(i, low, low is None or i == low)] += 1
    return out


def test_a_shingle_may_come_any_number_of_times(spark):
    n = probminhash.MOST + 5_713
    a, b, c = "a " * n + "b c d e f", "a " * n + "b c d e g", "a " * (n // 2) + "b c d e f"
    flat, size = probminhash.packed(pa.array([a]))
    item, times = probminhash.unpacked(flat)
    assert len(flat) == size[0] == len(item) + 1 and times.sum() == n + 1 and times.max() == n - 4
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(table(spark, [(1, a), (2, b), (3, a), (4, c), (5, "q r s t u v")])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_many_pairs_at_once_equal_single_ones():
    rng = random.Random(12)
    base = prose(rng, 80).split(" ")
    rows = []
    for k in range(30):
        own = list(base)
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(5)}"
        rows.append(" ".join(own) + (" " + " ".join(own[:20]) * (k % 3 == 0)) + (" tail of the text here " * (k % 4)))
    flat, n = probminhash.packed(pa.array(rows))
    ends = np.cumsum(n)
    items = [flat[e - c : e].tobytes() for e, c in zip(ends, n, strict=True)]
    i, j = np.triu_indices(30, 1)
    got = probminhash._similarities(items, i, j)
    want = np.array([probminhash.probability_jaccard(np.frombuffer(items[a], "<u8"), np.frombuffer(items[b], "<u8")) for a, b in zip(i, j, strict=True)])
    known = ~np.isnan(got)
    assert known.sum() > 50 and (~known).sum() > 50 and np.allclose(got[known], want[known], atol=1e-12)
    plain = [k for k in range(30) if k % 3 and not k % 4]
    i, j = (np.array(v) for v in zip(*((a, b) for a in plain for b in plain if a < b), strict=True))
    assert np.allclose(probminhash._similarities(items, i, j), [want[(a * (59 - a)) // 2 + b - a - 1] for a, b in zip(i, j, strict=True)], atol=1e-12)


@pytest.mark.parametrize(("part", "few"), [(512, 64), (3, 0)])
def test_families_that_no_star_links(spark, monkeypatch, part, few):
    """Chains of texts, each near its neighbours only: the stars leave links for the comparison inside tasks."""
    monkeypatch.setattr(probminhash, "BUCKET_ROWS", part)
    monkeypatch.setattr(probminhash, "FEW", few)
    monkeypatch.setattr(common, "CHUNK", 7 if part == 3 else 1 << 20)
    monkeypatch.setattr(probminhash, "FAMILY_ROWS", part)
    rng = random.Random(9)
    rows, own = [], prose(rng, 150, 3000).split(" ")
    for i in range(50):
        rows.append((i, " ".join(own)))
        at = 3 * i % len(own)
        own[at] = f"new{i}"
    rows += [(100 + i, " ".join(prose(rng, 10, 50).split(" ") + own[20:])) for i in range(8)]
    assert multiset(probminhash.near_duplicates(table(spark, rows))) == plain_classes(rows)


def test_classes_equal_brute_force(spark):
    rows = [(i, t) for i, t in texts() if t is None or len(t) < 20_000]
    rows += [(200, "x" * 60_000), (201, prose(random.Random(4), 2_500, 4000))]
    rows += [(202, rows[-1][1] + " more"), (203, "x" * 60_000)]
    assert multiset(probminhash.near_duplicates(table(spark, rows))) == plain_classes(rows)
    kept = probminhash.keep_first(table(spark, rows))
    assert kept.columns == table(spark).columns
    empty = sum(not words(t) for _, t in rows)
    named = {(k[1]) for k, n in plain_classes([r for r in rows if words(r[1])]).items()}
    assert kept.count() == empty + len(named)


def test_many_near_copies_and_a_shared_template(spark):
    rng = random.Random(3)
    base, frame = prose(rng, 120).split(" "), prose(rng, 60).split(" ")
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(len(own))] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(frame + prose(rng, 40).split(" "))) for i in range(60)]
    assert multiset(probminhash.near_duplicates(table(spark, rows))) == plain_classes(rows)


# operators 7 and 8


def test_thresholds_rise_and_severity_follows_the_words(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        own = prose(rng, 60).split(" ")
        for k in rng.sample(range(60), 1 + i % 5) if bad else ():
            own[k] = rng.choice(["nasty", "vilest", "vilely"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    held = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, rows), held)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.toxicity(table(spark, rows + [(900, None), (901, "")]), held).collect()
    right = sum(r.toxic == (r.doc_id < 900 and r.doc_id % 3 == 0) for r in got)
    assert right >= 0.97 * len(got)
    for r in got:
        assert r.p_1 >= r.p_2 >= r.p_3 and math.isclose(r.severity, r.p_1 + r.p_2 + r.p_3)
    many, one = ([r.severity for r in got if r.doc_id % 15 == k] for k in (9, 0))
    assert np.mean(many) > np.mean(one)
    empty = toxicity.toxicity(table(spark, []), held.where("false"))
    assert empty.count() == 0 and toxicity.toxicity(table(spark), held.where("false")).where("toxic").count() == 0


def test_em_finds_the_accuracies_of_simulated_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    accuracy, speaks = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.9, 0.7]), 0.7
    right = rng.random((len(truth), 8)) < accuracy
    vote = np.where(rng.random(right.shape) < speaks, np.where(right == truth[:, None], "+", "-"), "0")
    times = Counter("".join(v) for v in vote)
    model = weaklabel.expectation_maximisation(list(times), np.array(list(times.values()), dtype=float))
    assert abs(model.prior - 0.8) < 0.03 and np.abs(model.accuracies - accuracy).max() < 0.05


def test_classifier_keeps_prose_and_drops_junk(spark):
    import random

    rng = random.Random(4)
    good = [(i, prose(rng, 120)) for i in range(120)]
    junk = [(500 + i, " ".join(w + "###" for w in prose(rng, 90).split(" ")) if i % 2 else (prose(rng, 1).upper() + "!! ") * 90) for i in range(30)]
    rows = good + junk + [(900, None), (901, "")]
    got = {r.doc_id: r for r in weaklabel.classify(table(spark, rows)).collect()}
    assert sum(got[i].kept for i, _ in good) >= 118 and not any(got[i].kept for i, _ in junk)
    assert got[900].score == 0 and not got[901].kept
    assert weaklabel.classify(table(spark, [])).count() == 0
    assert weaklabel.classify(table(spark)).count() == len(texts())


# operator 10


def plain_model(rows, order=5):
    trie, unigrams = [defaultdict(Counter) for _ in range(order + 1)], Counter()
    streams = []
    for i, t in rows:
        own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        stream = b"\n" * order + " ".join(own).encode() + b"\n"
        learnt = zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
        streams.append((i, own, stream, learnt))
        if learnt:
            unigrams.update([*own, "\n"])
            for p in range(order, len(stream)):
                for k in range(order + 1):
                    trie[k][stream[p - k : p]][stream[p]] += 1
    n, v, out = sum(unigrams.values()), len(unigrams), []
    for i, own, stream, learnt in streams:
        score = 0.0
        for p in range(order, len(stream)):
            left_out = set()
            for k in range(order, -1, -1):
                held = {s: c for s, c in trie[k].get(stream[p - k : p], {}).items() if s not in left_out}
                total, kinds = sum(held.values()), len(held)
                if stream[p] in held:
                    score += math.log10(held[stream[p]] / (total + kinds))
                    break
                if kinds:
                    score += math.log10(kinds / (total + kinds))
                left_out |= set(held)
            else:
                score -= math.log10(252 - len(left_out))
        tokens = [*own, "\n"]
        base = sum(math.log10((unigrams[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, not learnt, len(tokens), sum(unigrams[w] > 0 for w in tokens), n, round(base, 6), round(score, 6)))
    return Counter(out)


def test_scores_equal_a_plain_model(spark):
    rows = [(i, t) for i, t in texts() if t is None or len(t) < 20_000]
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ppm.language_model_scores(table(spark, rows)).collect())
    assert got == plain_model(rows)


def scored_in_blocks(rows, n_blocks: int, shards: int = 5) -> tuple[list[pa.Table], int, int]:
    """The steps of the operator without Spark, and the most that numpy and Python held in the first and in the last one."""
    schema = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary())])
    as_table = lambda found: pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)
    cut = [pa.table({"doc_id": pa.array([i for i, _ in rows[k::n_blocks]], pa.int64()), "text": pa.array([t or "" for _, t in rows[k::n_blocks]])}) for k in range(n_blocks)]
    cut = [t.set_column(1, "text", pc.ascii_lower(t.column("text"))) for t in cut]
    tracemalloc.start()
    asked = [r for k, t in enumerate(cut) for r in ppm._requests(t, k, shards)]
    first = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs, ends = np.zeros(1 << 16, dtype=np.int64), 0
    for kind, _, _, keys, _, counts in asked:
        if kind == "pair":
            pairs[np.frombuffer(keys, dtype="<u4")] += np.frombuffer(counts, dtype="<i8")
        elif kind == "end":
            ends += int(np.frombuffer(counts, dtype="<i8")[0])
    grouped = defaultdict(list)
    for r in asked:
        if r[1] >= 0:
            grouped[r[:2]].append(r)
    answers = [a for own in grouped.values() for a in ppm._answer(as_table(own), ppm.LowOrders(pairs))]
    n, v = sum(np.frombuffer(a[5], dtype="<i8") for a in answers if a[0] == "all")
    held = [(t, as_table([a for a in answers if a[2] == k])) for k, t in enumerate(cut)]
    blobs = []
    for t, own in held:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        blobs.append((zstandard.ZstdCompressor().compress(sink.getvalue()), own))
    tracemalloc.start()
    done = [ppm._score(blob, own, int(n) + ends, int(v) + int(ends > 0), ends) for blob, own in blobs]
    last = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return done, first, last


def test_scores_do_not_depend_on_blocks_and_slices(monkeypatch):
    rows = [(i, t) for i, t in texts() if t is None or len(t) < 20_000]
    monkeypatch.setattr(ppm, "SLICE_BYTES", 300)
    monkeypatch.setattr(ppm, "GATHERED", 100)
    done, _, _ = scored_in_blocks(rows, 3)
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for t in done for r in t.to_pylist())
    assert got == plain_model(rows)


def test_a_block_is_scored_in_little_memory():
    rng = random.Random(7)
    known = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(2000)]
    weights = [1 / (1 + k) for k in range(len(known))]
    rows = [(i, " ".join(rng.choices(known, weights, k=1000))) for i in range(1500)]
    size = sum(len(t) for _, t in rows)
    _, first, last = scored_in_blocks(rows, 1)
    assert first < 10 * size
    assert last < 10 * size


def test_blocks_of_a_batch_are_even():
    held = pa.array(["a" * n for n in (5, 0, 9, 1, 1, 30, 2, 2)] + [None])
    cut = list(ppm._even(held, 20))
    assert [i for part in cut for i in range(len(held))[part]] == list(range(len(held)))
    assert [sum(len(t or "") for t in held[part].to_pylist()) for part in cut] == [16, 30, 4]
    assert list(ppm._even(pa.array([None, ""]), 20)) == [slice(0, 2)]
    texts_of_one = pa.array(["a"] * 27)
    assert [len(texts_of_one[part]) for part in ppm._even(texts_of_one, 24)] == [13, 14]


def test_costs_of_a_context_add_up_to_one(spark):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 400).astype(np.uint64)
    code = np.zeros(len(data) - 5, dtype=np.uint64)
    for k in range(6):
        code = (code << np.uint64(8)) | data[k : len(data) - 5 + k]
    code, count = np.unique(code, return_counts=True)
    pairs = np.bincount((code & np.uint64(0xFFFF)).astype(int), weights=count, minlength=1 << 16).astype(np.int64)
    context = code[0] >> np.uint64(8)
    # all bytes that a text can hold after one context, next to what was counted
    every = (context << np.uint64(8)) | np.array([b for b in range(256) if b not in (9, 11, 12, 13)], dtype=np.uint64)
    whole, at = np.unique(np.concatenate([code, every]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([count, np.zeros(len(every))]), minlength=len(whole))
    cost = ppm.costs(whole, n, ppm.LowOrders(pairs))
    assert math.isclose((10 ** cost[np.isin(whole, every)]).sum(), 1.0, rel_tol=1e-9)


# empty tables


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: pieces.tokenise(d, PIECES),
        lambda d: fertility.quality_rules(d, BYTES, PIECES),
        linerun.dedup_lines,
        lambda d: packing.pack(d, BYTES),
        probminhash.near_duplicates,
        probminhash.keep_first,
        weaklabel.keep_good,
        ppm.language_model_scores,
    ],
)
def test_an_empty_table_gives_an_empty_result(spark, apply):
    assert apply(table(spark, [])).count() == 0
