"""Operators that SQL cannot express, against brute force."""

import base64
import heapq
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from vexel.llm import decontaminate, language_model, line_dedup, near_dedup, packing, quality, registry, secrets, substring_dedup, token_count
from vexel.llm.common import read, text_slices

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def edit_distance(item: bytes, text: bytes) -> int:
    """Least distance of item to any part of text, by the full table, a row of it at a time."""
    t = np.frombuffer(text, dtype=np.uint8)
    before = np.zeros(len(t) + 1, dtype=np.int64)
    steps = np.arange(len(t) + 1)
    for i, c in enumerate(item, 1):
        row = np.empty_like(before)
        row[0] = i
        row[1:] = np.minimum(before[:-1] + (t != c), before[1:] + 1)
        before = np.minimum.accumulate(row - steps) + steps
    return int(before.min())


def test_myers_is_the_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (bytes(rng.integers(97, 100, n).tolist()) for n in (rng.integers(1, 40), rng.integers(0, 80)))
        assert decontaminate.myers(a, b) == edit_distance(a, b)


def leaks_of(items: dict, texts: dict) -> set:
    """(document, item, distance) within the budget, by full tables over all texts at once; without a budget, the item stands in the text as whole words."""
    plain = {d: decontaminate.reduce_text(t) for d, t in texts.items()}
    gap = bytes(1 + max((int(decontaminate.RATE * len(i)) for i in items.values()), default=0))
    begin = np.cumsum([0, *[len(t) + len(gap) for t in plain.values()]])[:-1]
    whole = np.frombuffer(b"".join(t + gap for t in plain.values()), dtype=np.uint8)
    out = set()
    for i, item in items.items():
        budget = int(decontaminate.RATE * len(item))
        if not budget:
            out |= {(d, i, 0) for d, t in plain.items() if item and b" " + item + b" " in b" " + t + b" "}
            continue
        before = np.zeros(len(whole) + 1, dtype=np.int32)
        steps = np.arange(len(whole) + 1, dtype=np.int32)
        for n, c in enumerate(item, 1):
            row = np.empty_like(before)
            row[0] = n
            np.minimum(before[:-1] + (whole != c), before[1:] + 1, out=row[1:])
            row -= steps
            before = np.minimum.accumulate(row, out=row) + steps
        out |= {(d, i, int(n)) for d, n in zip(plain, np.minimum.reduceat(before[1:], begin)) if n <= budget}
    return out


def test_decontamination(spark, texts):
    items = {r.item_id: decontaminate.reduce_text(r.text) for r in read(spark, SF, "benchmark").collect()}
    want = leaks_of(items, texts)
    assert set(map(tuple, registry.QUERIES["op1_decontaminate"](spark, SF).collect())) == want and want


def test_secret_scan_without_the_index(texts, spark):
    want = {(d, name, n, m.group()) for d, t in texts.items() for name, p in secrets.RULES.items() for n, m in enumerate(re.compile(p, re.ASCII).finditer(t), 1)}
    assert set(map(tuple, registry.QUERIES["op2_secret_scan"](spark, SF).collect())) == want


def naive_differencing(sizes, m):
    heap = [(-s, i, [s] + [0] * (m - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        sums = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        tick += 1
        heapq.heappush(heap, (sums[-1] - sums[0], tick, sums))
    return heap[0][2]


def test_differencing():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 3), (40, 7), (80, 2), (30, 30)):
        sizes = rng.integers(1, 500, n).tolist()
        windows = packing.differencing(sizes, m)
        assert sorted(i for w in windows for i in w) == list(range(n)) and len(windows) == m
        sums = [sum(sizes[i] for i in w) for w in windows]
        want = naive_differencing(sizes, m)
        assert max(sums) - min(sums) <= max(want) - min(want) + max(sizes) // 10
        assert sum(sums) == sum(want)


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_count.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=token_count.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_packing(spark, tokenizer):
    """Windows counted again with a tokenizer library: whole documents, no window over its capacity, all nearly equal, few more than the sum needs."""
    sf = "/root/testdata/sf0.01"
    sizes = {r.doc_id: len(tokenizer.encode_ordinary(r.text)) for r in read(spark, sf, "documents").collect()}
    out = registry.QUERIES["op3_packing"](spark, sf).collect()
    pieces, windows = defaultdict(list), defaultdict(int)
    for r in out:
        pieces[r.doc_id].append((r.start, r.tokens))
        windows[r.window_id] += r.tokens
    for d, n in sizes.items():
        at = 0
        for start, k in sorted(pieces[d]):
            assert start == at
            at += k
        assert at == n
    assert all(windows[r.window_id] == r.window_tokens <= packing.CAPACITY for r in out)
    sums = [n for w, n in windows.items() if "+" not in w]
    assert max(sums) - min(sums) <= 0.05 * packing.CAPACITY
    assert len(windows) <= 1.03 * -(-sum(sizes.values()) // packing.CAPACITY)


def test_packing_does_not_depend_on_cells(spark, tokenizer):
    """Windows of one cell and of many: as full, within what a window more in each cell takes."""
    docs = read(spark, SF, "documents")
    total = sum(len(tokenizer.encode_ordinary(r.text)) for r in docs.collect())
    for windows, rows in ((1000, 10**6), (8, 10**6), (1000, 20)):
        out = packing.pack_documents(docs, windows=windows, cell_rows=rows).collect()
        assert sum(r.tokens for r in out) == total
        sums = {r.window_id: r.window_tokens for r in out if "+" not in r.window_id}
        assert max(sums.values()) <= packing.CAPACITY and min(sums.values()) >= 0.75 * packing.CAPACITY


def test_token_counts(spark, texts, tokenizer):
    assert {r.doc_id: r.n_tokens for r in registry.QUERIES["op4_token_counts"](spark, SF).collect()} == {d: len(tokenizer.encode_ordinary(t)) for d, t in texts.items()}


def test_parts_are_those_of_the_pattern(tokenizer):
    """Letters, numbers, marks, contractions and all kinds of white space in any order, with and without the arrays of classes."""
    rng = np.random.default_rng(0)
    letters = list("aAzs tdmlrve'  \n\t'19é½ 漢😀\u0301\x1c\x85\u00a0.,! _")
    strange = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(5000)] + ["", "'ll'LL 's", " " * 500, "a" * 3000]
    want = [len(tokenizer.encode_ordinary(t)) for t in strange]
    ranks = token_count.load_ranks(token_count.VOCABULARY)
    for classes in (token_count.character_classes(), None):
        assert token_count.Counter(ranks, token_count.PATTERN, classes).column(pa.array(strange)).tolist() == want


def test_counts_when_the_memo_overflows(texts, tokenizer, monkeypatch):
    monkeypatch.setattr(token_count, "MEMO", 64)
    some = list(texts.values())[:20]
    counter = token_count.Counter(token_count.load_ranks(token_count.VOCABULARY), token_count.PATTERN, token_count.character_classes())
    for _ in range(2):
        assert counter.column(pa.array(some)).tolist() == [len(tokenizer.encode_ordinary(t)) for t in some]


def test_language_model_is_a_distribution(spark):
    """After contexts seen often, once and never, the chances of all words, the end and an unseen word add up to 1; unseen text is less likely than held-out text of the same kind."""
    train = spark.createDataFrame([(i, f"the cat number {i} sat on the mat and looked at the dog") for i in range(40)] + [(99, "a lone dog")], "doc_id long, text string")
    known = language_model.train(train)
    model = language_model.Model(**known)
    hashed = lambda w: language_model.sequence(*slice_of(w))[0][2:-1]
    vocabulary = np.concatenate([hashed(" ".join([*(str(i) for i in range(40)), *"the cat number sat on mat and looked at dog a lone".split()])), [language_model.END], hashed("neverseen")])
    assert len(vocabulary) == known["vocabulary"] + 1
    for context in ("the cat", "cat number", "lone dog", "number 7", "dog dog", "zq the", "zq zq"):
        a, b = hashed(context)
        total = model.probability(np.full(len(vocabulary), a), np.full(len(vocabulary), b), vocabulary).sum()
        assert abs(total - 1) < 1e-9, context
    begin = np.full(len(vocabulary), language_model.BEGIN)
    assert abs(model.probability(begin, begin, vocabulary).sum() - 1) < 1e-9
    test = spark.createDataFrame([(1, "the cat number 77 sat on the mat"), (2, "zq xv jw kp qqz vvx")], "doc_id long, text string")
    p = {r.doc_id: r.perplexity for r in language_model.perplexity(test, known).collect()}
    assert p[1] * 5 < p[2]


def slice_of(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return data, np.array([0, len(data)])


def test_language_model_in_many_buckets(spark, docs):
    """Frequent words are spread over buckets, and nothing changes."""
    one = {r.doc_id: r.perplexity for r in language_model.score(docs).collect()}
    known = language_model.train(docs, bucket_bytes=20_000, flush=5000)
    assert known["spread"].buckets > 10 and len(known["spread"].frequent)
    many = {r.doc_id: r.perplexity for r in language_model.perplexity(docs, known).collect()}
    assert one.keys() == many.keys() and all(one[d] == pytest.approx(many[d], rel=1e-12) for d in one)


def test_language_model_counts_in_shares(spark, docs, monkeypatch):
    """No pass sends more than its share of the blocks, and together they send every trigram once."""
    passes, inner = [], language_model._trigrams
    monkeypatch.setattr(language_model, "_trigrams", lambda *args: passes.append(inner(*args)) or passes[-1])
    known = language_model.train(docs, bucket_bytes=20_000)
    batch = pa.RecordBatch.from_arrays([pa.array([r.text for r in docs.select("text").collect()], pa.string())], ["text"])
    sent = lambda run: [(n, b) for out in run(iter([batch])) for n, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    whole, shares = sent(inner(known["spread"], language_model.FLUSH)), [sent(run) for run in passes]
    assert max(sum(len(b) for _, b in share) for share in shares) < 0.6 * sum(len(b) for _, b in whole)
    assert sorted(n for share in shares for n, _ in share) == sorted(n for n, _ in whole)
    events = lambda blocks: sum(int(language_model._unblock(b, 3)[3].sum()) for _, b in blocks)
    assert sum(map(events, shares)) == events(whole)


def test_stored_table():
    """Small and large counts, and hashes that are alike in the searched half."""
    rng = np.random.default_rng(2)
    key = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000, dtype=np.uint64), (np.uint64(7) << np.uint64(32)) + np.arange(50, dtype=np.uint64)]))
    value = rng.integers(1, 600, (len(key), 3))
    table = language_model.Table(np.frombuffer(language_model.store(key, value), dtype=np.uint8))
    shuffled = rng.permutation(len(key))
    assert (table.get(key[shuffled]) == value[shuffled]).all()
    assert not table.get(np.array([(7 << 32) + 99, 3], dtype=np.uint64)).any()
    assert language_model.Table(np.frombuffer(language_model.store(key[:0], value[:0]), dtype=np.uint8)).get(key[:2]).shape == (2, 3)


def recurring(texts):
    """A tree on strings, with the operator's hashes for the order of lines alone: the lines' hashes that go."""
    leaves, signs = defaultdict(dict), defaultdict(lambda: defaultdict(set))
    kept = {}
    for _, data, offsets in text_slices(pa.array(list(texts))):
        x = line_dedup.Lines(data, offsets, line_dedup.LEAD)
        for s, e, h, r in zip(x.starts, x.ends, x.hash, x.row):
            tokens = tuple("<*>" if any(c.isascii() and c.isdigit() for c in w) else w for w in data[s:e].tobytes().decode().split())
            leaves[len(tokens), tokens[: line_dedup.LEAD]][int(h)] = tokens
            signs[int(h)][int(x.sign[r])].add(data[offsets[r] : offsets[r + 1]].tobytes())
    for lines in leaves.values():
        found = []
        for h in sorted(lines):
            tokens = lines[h]
            scores = [sum(a == b for a, b in zip(t, tokens)) for t, _ in found]
            best = int(np.argmax(scores)) if scores else -1
            if best >= 0 and scores[best] >= line_dedup.SIMILAR * len(tokens):
                t, members = found[best]
                found[best] = ([a if a == b else None for a, b in zip(t, tokens)], [*members, h])
            else:
                found.append((list(tokens), [h]))
        for _, members in found:
            seen = defaultdict(set)
            for h in members:
                for s, d in signs[h].items():
                    seen[s] |= d
            if len(seen) >= line_dedup.MIN_DOCS and len(seen) >= line_dedup.SPREAD * sum(map(len, seen.values())):
                kept.update(dict.fromkeys(members))
    return kept.keys()


def without_lines(text, gone):
    """text without lines whose hash is in gone; None if no other line but blank ones is left."""
    if not gone:
        return text
    lines = text.split("\n")
    hashes = [[int(h) for _, data, offsets in text_slices(pa.array([x])) for h in line_dedup.Lines(data, offsets, line_dedup.LEAD).hash] for x in lines]
    left = [x for x, h in zip(lines, hashes) if not (h and h[0] in gone)]
    dropped = len(left) < len(lines)
    return None if dropped and not any(x.strip(" \t\r\x0b\x0c") for x in left) else "\n".join(left)


def test_line_dedup(docs, texts):
    got = {r.line & (1 << 64) - 1 for r in line_dedup.recurring_lines(docs).collect()}
    assert got == recurring(texts.values()) and got


def triples(text):
    """Word triples of a text, independent of the operator's hashes."""
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + near_dedup.SHINGLE]) for i in range(max(1, len(w) - near_dedup.SHINGLE + 1))} if w else set()


def similarities(texts):
    """Jaccard similarity of all pairs that share a triple."""
    sets = {d: s for d, t in texts.items() if (s := triples(t))}
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    shared = defaultdict(int)
    for ids in index.values():
        for a, b in combinations(ids, 2):
            shared[a, b] += 1
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}


def test_near_dedup_recall(spark):
    """From the threshold up, near pairs are in one group; and each member of a group is near to another one."""
    sf = "/root/testdata/sf0.01"
    near = similarities({r.doc_id: r.text for r in read(spark, sf, "documents").collect()})
    out = registry.QUERIES["op8_near_dedup"](spark, sf).collect()
    group = {r.doc_id: r.group_id for r in out}
    pairs = [p for p, j in near.items() if j >= near_dedup.THRESHOLD]
    assert pairs and sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs) >= 0.99 * len(pairs)
    far = defaultdict(float)
    for (a, b), j in near.items():
        if group.get(a, -1) == group.get(b, -2):
            far[a], far[b] = max(far[a], j), max(far[b], j)
    assert min(far[d] for d in group) >= near_dedup.THRESHOLD - 0.01
    size = defaultdict(int)
    for g in group.values():
        size[g] += 1
    assert all(r.group_size == size[r.group_id] for r in out)


def test_near_dedup_drops_chance_pairs(spark):
    """Signatures that share the first minima of a tree and little else are no candidates; those that agree just enough are, all of them."""
    rng = np.random.default_rng(5)
    sigs = rng.integers(0, 1 << 16, (400, 128), dtype=np.uint16)
    sigs[:, :32:8] = 7
    for i in range(0, 40, 2):
        # 52 of 128 minima agree: the least share above THRESHOLD - MARGIN.
        sigs[i + 1] = sigs[i] + 1
        sigs[i + 1, [*range(8), *range(20, 64)]] = sigs[i, [*range(8), *range(20, 64)]]
    reps = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "key long, sig binary")
    found = {(r.a, r.b) for r in near_dedup._forest_pairs(reps, 16, 8, 6).collect()}
    assert {(i, i + 1) for i in range(0, 40, 2)} <= found
    assert len(found) < 800  # thousands meet; at the ends of partitions none is dropped
    brief = near_dedup.sketch(sigs)
    assert (near_dedup.differing(brief[:200], brief[200:]) <= (sigs[:200] != sigs[200:]).sum(axis=1)).all()


def test_near_dedup_in_a_crowd(spark):
    """Pairs just above the threshold, among thousands of texts that all share a passage."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    passage = [word() for _ in range(40)]
    texts = [" ".join(passage + [word() for _ in range(80)]) for _ in range(3000)]
    for i in range(0, 200, 2):
        own = texts[i].split()
        texts[i + 1] = " ".join(own[:92] + [word() for _ in range(28)])
    found = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[2].collect()}
    assert min(len(triples(texts[i]) & triples(texts[i + 1])) / len(triples(texts[i]) | triples(texts[i + 1])) for i in range(0, 200, 2)) >= near_dedup.THRESHOLD
    assert sum(found.get(i) == i == found.get(i + 1) for i in range(0, 200, 2)) >= 95
    assert len(found) <= 200


def test_walk_goes_where_prefixes_are_longer():
    """By hand: the common prefixes of each row and the next; row 2 meets two on its left, where they are longer."""
    a, b = near_dedup.nearest(np.array([5, 4, 2, 1, 0], np.int8), 2, 2, 3)
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 0), (2, 1)]
    a, b = near_dedup.nearest(np.array([1, 2, 3, 3, 0], np.int8), 3, 2, 3)
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1), (2, 3), (2, 4)]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def estimates(x, groups):
    """{group: (location, precision)} by plain concentration steps; groups: {group: (members, wider group)}, wider ones first."""
    floor = np.diag(np.array(quality.FLOOR) ** 2)
    factor, shrink, bins = quality.consistency(quality.COVER), quality.SHRINK, quality.BINS

    def quartile(v, q):
        b = np.sort(np.floor(v * 512))
        return (b[int(np.ceil(q * len(b))) - 1] + 0.5) / 512

    def start(members, s):
        v = x[members]
        a, m, b = (np.array([quartile(v[:, i], q) for i in range(quality.P)]) for q in (0.25, 0.5, 0.75))
        scale = np.maximum((b - a) / 1.349, quality.FLOOR)
        c = np.cov(v.T, bias=True).reshape(quality.P, quality.P) + floor if len(v) > 1 else floor
        ratio = scale / np.sqrt(np.diag(c))
        return [(m, np.diag(scale**2)), (v.mean(axis=0), c), (m, c * np.outer(ratio, ratio))][s]

    def step(now, top):
        new = {}
        for g, (members, up) in groups.items():
            m, c = now[g]
            v = x[members]
            d = np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c), v - m)
            b = np.floor(np.log2(np.maximum(d, 1e-9)) * bins)
            w = np.zeros(len(v))
            left = quality.COVER * len(v)
            for one in np.unique(b):
                here = b == one
                w[here] = min(1.0, max(0.0, left / here.sum()))
                left -= here.sum()
            n, mean = w.sum(), (w[:, None] * v).sum(axis=0) / w.sum()
            scatter = np.einsum("i,ij,ik->jk", w, v - mean, v - mean) / n * factor
            wide, prior = now[up] if up else top
            off = mean - wide
            new[g] = (n * mean + shrink * wide) / (n + shrink), (n * scatter + shrink * prior + n * shrink / (n + shrink) * np.outer(off, off)) / (n + shrink) + floor
        return new

    det = lambda e: np.linalg.slogdet(e[1])[1]
    top = start(groups["*"][0], 0)
    chains = [{g: start(members, s) for g, (members, _) in groups.items()} for s in range(3)]
    for _ in range(2):
        chains = [step(c, top) for c in chains]
    now = {g: min((c[g] for c in chains), key=det) for g in groups}
    while True:
        new = step(now, top)
        fall = max(det(now[g]) - det(new[g]) for g in groups)
        now = new
        if fall <= quality.CLOSE:
            return now


def test_quality_against_plain_concentration_steps(spark):
    """Each of the 80 groups has its own estimate, none with more than 38 documents."""
    sf = "/root/testdata/sf0.01"
    rows = read(spark, sf, "documents").select("doc_id", "text", "lang", "source").collect()
    x = np.concatenate([quality.statistics(d, o) for _, d, o in text_slices(pa.array([r.text for r in rows]))])
    some = np.flatnonzero(~np.isnan(x[:, 0]))
    groups = {"*": (some, None)}
    for lang in sorted({r.lang for r in rows}):
        groups[lang] = (np.array([i for i in some if rows[i].lang == lang]), "*")
    for lang, source in sorted({(r.lang, r.source) for r in rows}):
        groups[lang, source] = (np.array([i for i in some if (rows[i].lang, rows[i].source) == (lang, source)]), lang)
    assert max(len(m) for g, (m, _) in groups.items() if isinstance(g, tuple)) < 200
    found = estimates(x, groups)
    limit = quality.CUTOFF * quality.chi2_quantile(0.999, quality.P)
    got = {r.doc_id: r for r in registry.QUERIES["op10_quality_rules"](spark, sf).collect()}
    assert got.keys() == {r.doc_id for r in rows}
    for g, (members, _) in groups.items():
        if isinstance(g, tuple):
            m, c = found[g]
            d = np.einsum("ij,jk,ik->i", x[members] - m, np.linalg.inv(c), x[members] - m)
            for i, v in zip(members, d):
                r = got[rows[i].doc_id]
                assert r.distance == pytest.approx(v, rel=1e-3, abs=2e-3)
                assert r.rejected == (v > limit) or abs(v - limit) < 0.1
    good = read(spark, sf, "labels").where("quality = 1").select("doc_id").collect()
    assert sum(got[r.doc_id].rejected for r in good) <= 0.01 * len(good)


def test_quality_joined_by_shuffle(spark, docs):
    plain, shuffled = ([(rows["doc_id"], judged) for rows, judged in [quality.assess(docs, broadcast_groups=n)]][0] for n in (1000, 0))
    a, b = (sorted((r[0], r[1], round(r[2], 6)) for r in judged.select(i, "__vx_reject", "__vx_distance").collect()) for i, judged in (plain, shuffled))
    assert [r[:2] for r in a] == [r[:2] for r in b] and all(u[2] == pytest.approx(v[2], rel=1e-6) for u, v in zip(a, b))


def longest_repeats(words, least):
    """Matches of all pairs of documents along all diagonals; those in no longer one."""
    windows = defaultdict(list)
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            windows[tuple(w[i : i + least])].append((d, i))
    diagonals = defaultdict(set)
    for places in windows.values():
        for (a, i), (b, j) in combinations(places, 2):
            if a != b:
                diagonals[a, b, j - i].add(i)
                diagonals[b, a, i - j].add(j)
    spans = defaultdict(set)
    for (a, _, _), starts in diagonals.items():
        for i in starts:
            if i - 1 not in starts:
                j = i
                while j + 1 in starts:
                    j += 1
                spans[a].add((i, j + least))
    return {(d, x, y) for d, s in spans.items() for x, y in s if not any((u, v) != (x, y) and u <= x and y <= v for u, v in s)}


def test_substring_dedup(spark, texts):
    words = {d: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()) for d, t in texts.items()}
    assert set(map(tuple, registry.QUERIES["op7_substring_dedup"](spark, SF).collect())) == longest_repeats(words, substring_dedup.LEAST)


@pytest.mark.parametrize("anchors", [1000, 0])
def test_substring_dedup_partner_by_partner(spark, anchors):
    """Passages side by side from different partners stay apart; nested, overlapping and widely shared ones, near copies, runs of one word."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    some = lambda n: [word() for _ in range(n)]
    a, b, c = some(50), some(50), some(120)
    texts = [a + b, some(9) + a + some(3), some(4) + b, c, some(5) + c[:80] + some(2), c[40:] + some(6), some(1) + c[10:70] + some(1), some(30) + c[20:69] + some(9)]
    texts += [some(int(rng.integers(0, 3))) + c[30:90] + ["the"] * int(rng.integers(0, 2)) + some(3) for _ in range(30)]
    line, other = some(55), some(12)
    texts += [some(3) + line * 6 + some(4), some(1) + line + some(2), line[:54] + some(5), some(2) + other * 9, other * 14 + some(1), some(5) + other * 6 + some(2) + other * 5]
    whole = some(300)
    for _ in range(25):
        copy = list(whole)
        for i in rng.integers(0, 300, 3):
            copy[i] = word()
        texts.append(copy)
    texts += [["go"] * 90 + some(3), some(2) + ["go"] * 70 + ["stop"], ["go"] * 55 + ["stop"], ["alone"] * 200]
    words = dict(enumerate(texts))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()], "doc_id long, text string")
    got = set(map(tuple, substring_dedup.repeats(df, broadcast_anchors=anchors).collect()))
    assert got == longest_repeats(words, substring_dedup.LEAST)
    assert {r for r in got if r[0] == 0} == {(0, 0, 50), (0, 50, 100)}


def test_substring_rounds_move_only_what_goes_on(spark):
    """Most texts are done in the first round; the rounds that a few need don't move the others' words."""
    rng = np.random.default_rng(11)
    some = lambda n: [f"{x:08x}" for x in rng.integers(0, 1 << 32, n)]
    texts = []
    for _ in range(150):
        passage = some(200)
        texts += [passage + some(30), some(30) + passage]
    for _ in range(6):
        passage = some(300)
        texts += [passage[: 60 + 6 * i] + some(5) for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4).cache()
    df.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    key, before = "spark.sql.autoBroadcastJoinThreshold", written()
    spark.conf.set(key, "-1")  # as it is for tables beyond it
    try:
        got = set(map(tuple, substring_dedup.repeats(df).collect()))
    finally:
        spark.conf.unset(key)
    moved = written() - before
    assert got == longest_repeats(dict(enumerate(texts)), substring_dedup.LEAST)
    assert moved < 6 * sum(len(w) * 9 for w in texts), moved


def test_pipeline(spark, docs, tokenizer):
    """Stage by stage on what the stage before kept, each against brute force."""
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        new = stage(spark, kept, SF).cache()
        after = {r.doc_id: r.text for r in new.collect()}
        assert new.columns == docs.columns
        if name == "quality_rules":
            gone = kept.join(new, "doc_id", "left_anti").join(read(spark, SF, "labels"), "doc_id")
            assert gone.where("quality = 1").count() <= 0.05 * gone.count() + 1
            assert after.items() <= before.items()
        if name == "line_dedup":
            lines = recurring(before.values())
            assert after == {d: t for d, text in before.items() if (t := without_lines(text, lines)) is not None}
        if name == "near_dedup":
            assert not [p for p, j in similarities(after).items() if j >= near_dedup.THRESHOLD]
            near = {d for p, j in similarities(before).items() if j >= near_dedup.THRESHOLD for d in p}
            assert before.keys() - after.keys() <= near
        if name == "decontamination":
            items = {r.item_id: decontaminate.reduce_text(r.text) for r in read(spark, SF, "benchmark").collect()}
            assert after.keys() == before.keys() - {d for d, _, _ in leaks_of(items, before)}
        kept = new
    sizes = {r.doc_id: len(tokenizer.encode_ordinary(r.text)) for r in kept.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    got, windows = defaultdict(int), defaultdict(int)
    for r in out:
        got[r.doc_id] += r.tokens
        windows[r.window_id] += r.tokens
    assert got == sizes and max(windows.values()) <= packing.CAPACITY
