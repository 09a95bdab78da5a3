"""Training-data operators against brute force, on small fixtures with nulls, copies, ties and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("orrery.llm")

from orrery.llm import chat, components, importance, media, mixing, near_dedup, packing, rules, substring, token_counts, urls  # noqa: E402
from orrery.llm.tokens import WordTokenizer  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _starts int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(70)
    base = [say(rng.randint(20, 140)) for _ in range(25)]
    out = [*base, base[0], base[1], base[1].replace("w1", "x1", 1), None, "", "  ", "one two", "one two", "one two three", passage]
    out += [f"{say(30)} {passage}\n{say(20)}" for _ in range(4)]
    for b in base[:6]:  # near copies and copies of copies
        words = b.split()
        for _ in range(4):
            words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
    out.append(" ".join(say(4000).split()))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 4}", len(t or ""), "own", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts, percent):
    sets = [shingles(t) for t in texts]
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return sets, [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, docs, texts, percent):
    sets, want = brute_components(texts, percent)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, percent=percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(want))
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    if percent == 80:
        left = near_dedup.drop_near_duplicates(docs)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_near_duplicates_edges(spark, docs):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "A B c d  e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()), key=str)
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (None, None, None)]


def test_pruning_limits():
    limits = near_dedup.least_matches(0.8, 1e-4)
    assert [n for n, _ in limits] == list(near_dedup.BATCHES) and all(m < 0.8 * n for n, m in limits) and limits[-1][1] > 170


@pytest.mark.parametrize("percent", [80, 85])
def test_no_pair_at_the_threshold_is_pruned(docs, monkeypatch, percent):
    """The probability to drop a pair exactly at the threshold, summed over batches, for every pruning that a run does."""
    used, limits = [], near_dedup.least_matches
    monkeypatch.setattr(near_dedup, "least_matches", lambda *a: used.append(limits(*a)) or used[-1])
    near_dedup.near_duplicates(docs, percent=percent)
    s = percent / 100
    for batches in used:
        alive, done, lost = np.ones(1), 0, 0.0
        for n, least in batches:
            k, done = n - done, n
            alive = np.convolve(alive, [math.comb(k, j) * s**j * (1 - s) ** (k - j) for j in range(k + 1)])
            lost, alive[:least] = lost + alive[:least].sum(), 0
        assert lost < 1e-5
    assert len(used) >= 2


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 1)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_substrings(spark, docs, texts):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = {}
    for i, w in enumerate(words):
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want[i] = (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    spans = substring.repeated_spans(docs)
    for s in spans.collect():  # source coordinates point at the same words
        n = s.n + 12
        assert words[s.doc_id][s.start : s.start + n] == words[s.source][s.source_start : s.source_start + n] and s.source < s.doc_id
    got = {r.doc_id: (r._cut_n_words, r._cut_n_removed, r._cut_text) for r in substring.cut_spans(docs, spans).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 300


def test_substring_paths(spark):
    """Spans carry the maximal non-branching paths of the graph of repeated windows: brute force over branching texts."""
    rng = random.Random(12)
    say = lambda n: [f"v{rng.randrange(10_000)}" for _ in range(n)]
    p, q, x, y, z = say(40), say(30), say(25), say(20), say(16)
    made = [p + x, p + y, say(5) + p[20:] + x, q + p, z + q + p[:25], y + say(3) + z, p[:30] + say(2), x + q, z * 3, say(9) + z * 2, say(2) + p[5:] + y]
    docs_ = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string").repartition(3)
    where = collections.defaultdict(list)
    for i, w in enumerate(made):
        for a in range(len(w) - 12):
            where[tuple(w[a : a + 13])].append((i, a))
    edges = {e for e, at in where.items() if len({i for i, _ in at}) > 1}
    ins, outs = collections.Counter(e[1:] for e in edges), collections.Counter(e[:-1] for e in edges)
    plain = {n for n in ins if ins[n] == 1 and outs[n] == 1}
    name = {e: e for e in edges}

    def root(e):
        while name[e] != e:
            e = name[e]
        return e

    after = {e[:-1]: e for e in edges}
    for e in edges:
        if e[1:] in plain:
            name[root(e)] = root(after[e[1:]])
    want, got = {}, {}
    for s in substring.repeated_spans(docs_).collect():
        for j in range(s.n):
            e = tuple(made[s.doc_id][s.start + j : s.start + j + 13])
            assert (s.source, s.source_start + j) == min(where[e]) and s.source < s.doc_id
            assert got.setdefault(e, s.path) == s.path
            want[e] = root(e)
    assert set(got) == edges  # each repeated window is removed somewhere
    pairs = set(zip(map(want.get, edges), map(got.get, edges), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) >= 3
    assert any(ins[n] > 1 or outs[n] > 1 for n in set(ins) & set(outs))


def test_unconfirmed_spans_stay(spark, docs):
    """A span whose source has other words (as after a collision of hashes) is not cut."""
    spans = substring.repeated_spans(docs)
    wrong = spans.withColumn("source_start", F.col("source_start") + 1)
    assert substring.cut_spans(docs, spans).agg(F.sum("_cut_n_removed")).first()[0] > 300
    assert substring.cut_spans(docs, wrong).agg(F.sum("_cut_n_removed")).first()[0] == 0


def test_substring_edges(spark, docs, texts):
    assert substring.dedup_substrings(empty(spark)).count() == 0
    text = " ".join(f"t{i}" for i in range(15))
    odd = spark.createDataFrame([(None, text), (3, text), (5, text), (5, f"{text} {text}")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in substring.dedup_substrings(odd).collect())
    assert got == [("3", text), ("5", ""), ("5", ""), ("None", text)]
    out = substring.dedup_substrings(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(range(len(texts)))


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_tokens_equal_the_library(texts, name, kind):
    rng = random.Random(1)
    parts = [" ", "\n", "a", "B", ".", "'", "s", "é", "É", "*", "  ", "1", "\t", "ß", "\u0301", "<|endoftext|>", "日本", "\u00a0", "|", "İ", "Σ", "\x01"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    t = WordTokenizer(public_tokenizers.path(name), kind)
    everything = [*texts, *odd]
    ids, offsets = t.batch(pa.array(everything, pa.string()))
    for i, x in enumerate(everything):
        assert t.library.encode(x or "", add_special_tokens=False).ids == ids[offsets[i] : offsets[i + 1]].tolist(), repr(x)


def test_token_counts_use_the_cache(spark, docs, texts, tmp_path, monkeypatch):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = WordTokenizer(path, "byte").library
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path, "byte", cache).collect()}
        assert got == want
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts})  # the second run added nothing
    assert token_counts.count_tokens(empty(spark), path, "byte", cache).count() == 0


def test_packing(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = WordTokenizer(path, "word").library
    rows = packing.pack(docs, path, capacity=128, with_ids=True).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum((r.ids for r in own), []) == ids and [r.start for r in own] == [128 * k for k in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) for r in own)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 128
    bound = -(-sum(r.length for r in rows) // 128)
    assert len(bins) <= 1.04 * bound + 1
    assert packing.pack(empty(spark), path).count() == 0


def test_packing_across_blocks(spark):
    rng = random.Random(4)
    sizes = [rng.randint(1, 99) for _ in range(900)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    rows = packing.pack_items(items, 100, block_items=100).collect()
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert sorted(r.uid for r in rows) == list(range(900)) and max(fill.values()) <= 100
    assert len(fill) <= 1.03 * packing.lower_bound(sizes, 100)


def test_crossover_keeps_every_item():
    rng, sizes = random.Random(2), [random.Random(i).randint(1, 60) for i in range(80)]
    order = list(range(80))
    a, b = packing.decreasing(sizes, 100, order), packing.decreasing(sizes, 100, order[::-1])
    child = packing.crossover(a, b, sizes, rng)
    assert sorted(i for own in child.items for i in own) == order
    assert all(sum(sizes[i] for i in own) == 100 - f for own, f in zip(child.items, child.free, strict=True))


def test_islands_save_a_bin():
    """Items cut from full bins: best fit needs more bins than there are, evolution finds the cut or comes nearer to it."""
    rng, better = random.Random(8), 0
    for case in range(6):
        sizes = []
        for _ in range(40):
            cuts = sorted(rng.sample(range(1, 1000), 3))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 1000], strict=True)]
        sizes += [400, 300, 200]
        rng.shuffle(sizes)
        first = packing.decreasing(sizes, 1000, sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True))
        best, crossed = packing.evolve(sizes, 1000, [], case)
        assert sorted(i for b in best.items for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) + f == 1000 and f >= 0 for b, f in zip(best.items, best.free, strict=True))
        assert packing.lower_bound(sizes, 1000) == 41 <= len(best.items) <= len(first.items) and (crossed > 0 or len(first.items) == 41)
        better += len(best.items) < len(first.items)
        again, _ = packing.evolve(sizes, 1000, [first.items, best.items], case)
        assert again.value() <= best.value()
    assert better > 0


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_fewest_sequences(spark, scale):
    """The tables pack at their lower bounds."""
    docs_ = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")
    rows = packing.pack(docs_, public_tokenizers.path("word_bpe_49k.json")).select("length", "sequence_id").collect()
    lengths = [r.length for r in rows if r.length < 2048]
    assert len({r.sequence_id for r in rows}) == len(rows) - len(lengths) + packing.lower_bound(lengths, 2048)


def test_mixing(spark, docs, texts):
    rows = mixing.copies(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    total, by = sum(size.values()), collections.defaultdict(list)
    for r in rows:
        assert r.size == size[r.doc_id] and r.copies <= 3
        by[r.source].append(r)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s)))}
    caps = {s: 3 * sum(r.size for r in own) for s, own in by.items()}
    fixed, target = set(), {}
    while True:
        rest = total - sum(caps[s] for s in fixed)
        target = {s: caps[s] if s in fixed else rest * w / sum(x for k, x in weights.items() if k not in fixed) for s, w in weights.items()}
        over = {s for s in target if target[s] > caps[s] * (1 + 1e-12)}
        if not over:
            break
        fixed |= over
    for s, own in by.items():
        assert own[0].target == pytest.approx(target[s]) and abs(sum(r.size * r.copies for r in own) - target[s]) <= 2 * max(r.size for r in own)
    again = {(r.doc_id, r.copies) for r in mixing.copies(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows) and mixed.first().size == "own"
    assert mixing.copies(empty(spark)).count() == 0


def test_rules(spark, docs, texts):
    for r in rules.judge(docs).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {q for p in range(len(w) - 2) if seen[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert (r.n_symbols, r.n_capitals, r.n_shouts) == (len(re.findall(r"[#*$%&|<>]", t)), len(re.findall("[A-Z]", t)), t.count("!"))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r.base_failed or not r.kept) and 0 <= r.probability <= 1
    assert rules.judge(empty(spark)).count() == 0


def test_rules_find_faults_without_labels(spark):
    good = [f"This is line {i} of a plain text about topic {i}.\n" + ". ".join(f"word{i + j} follows other{j}" for j in range(30)) + "." for i in range(300)]
    bad = [" ".join(f"word{i + j}*** %%%" for j in range(60)) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    kept = {r.doc_id for r in rules.judge(rows).where("kept").collect()}
    assert kept == set(range(300))


def test_votes_and_posterior_by_brute_force(spark):
    rng = random.Random(11)
    made = ["", None, "# " * 30, "ok. " * 80, "A! " * 60, "x\n" * 20, "**" * 40, "SHOUT " * 60]
    made += [" ".join(rng.choice(["word", "Other.", "#", "!", "LOUD", "a", "\n", "thing", "longer-one", "same same"]) for _ in range(rng.randint(5, 160))) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in rules.judge(frame).collect()}
    votes = []
    for i, t in enumerate(made):
        r, t = got[i], t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        chars, n, ended = sum(map(len, w)), len(w), sum(bool(re.search(r"[.!?:;\"')] *$", x)) for x in lines)
        symbols, capitals, shouts, dup = len(re.findall(r"[#*$%&|<>]", t)), len(re.findall("[A-Z]", t)), t.count("!"), len(lines) - len(set(lines))
        one = lambda bad, good: -1 if bad else 1 if good else 0
        votes.append([
            one(n < 20, n >= 50), one(10 * symbols > n, 50 * symbols <= n > 0), one(len(lines) >= 6 and 10 * dup > 3 * len(lines), dup == 0 and len(lines) >= 3),
            one(10 * r.n_repeat_words > 3 * n, 10 * r.n_repeat_words <= n >= 50), one(n > 0 and not 3 * n <= chars <= 12 * n, 4 * n <= chars <= 9 * n and n > 0),
            one(10 * capitals > 3 * chars or 10 * shouts > n, 10 * capitals <= chars and 50 * shouts <= n and n > 0), one(10 * ended < 2 * len(lines), 10 * ended >= 8 * len(lines) > 0),
        ])
        assert votes[-1] == [r[x.name] for x in rules.RULES], repr(t)
    v = np.array(votes, float)
    up, down, there = v == 1, v == -1, np.abs(v).sum(axis=0)
    p, g, b = 0.8, np.full(7, 0.995), np.full(7, 0.2)
    posterior = lambda: 1 / (1 + np.exp(-(math.log(p / (1 - p)) + (up * np.log(g / (1 - b)) + down * np.log((1 - g) / b)).sum(axis=1))))
    for _ in range(30):
        q = posterior()[:, None]
        s, s2, s3 = 10 * there + 10, 0.05 * there + 10, 0.1 * len(v) + 10
        p, g, b = (q.sum() + s3 * 0.8) / (len(v) + s3), ((up * q).sum(0) + s * 0.995) / ((np.abs(v) * q).sum(0) + s), ((down * (1 - q)).sum(0) + s2 * 0.2) / ((np.abs(v) * (1 - q)).sum(0) + s2)
    want = posterior()
    for i, r in got.items():
        assert r.probability == pytest.approx(want[i], rel=1e-9) and r.kept == (not r.base_failed and want[i] >= 0.5)


def test_rules_on_odd_rows(spark):
    long = "A line of plain words, and so on.\n" * 40_000
    rows = [(1, long, 7), (1, long, 7), (None, "a b c", 7), (2, None, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = rules.judge(frame).collect()
    assert len(got) == 4 and sorted(r.n_words for r in got) == [0, 3, 320_000, 320_000] and {r.n_dup_lines for r in got if r.n_words > 3} == {39_999}


def test_urls(spark):
    urls_ = ["http://A.example.org/es/x?q#f", "https://example.org/en/12", "http://x.com/fr/1", "com/fr/", None, "ftp://h.com", "http://notexample.org/es/", "x://org/", "http://example.org"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls_)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("com/fr/", "allow") and got[3] == got[4] == ("", "", None, "allow") and got[5] == ("h.com", "", None, "allow")
    assert got[6][2:] == ("org/", "allow") and got[7][2:] == ("org/", "allow") and got[8][1:3] == ("", None)


def test_reputation_shrinks(spark):
    rows = [(i, f"http://h{i % 10}.d{i % 2}.com/p", int(i % 10 == 3)) for i in range(400)] + [(1000, "http://new.d1.com/p", None), (1001, "http://h3.d1.com/p", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in urls.filter_urls(frame, frame.select("page_id", "bad")).collect()}
    assert got[1001].verdict == "block" and got[1000].verdict == "allow" and got[0].verdict == "allow"
    assert 0 < got[1000].bad_rate < got[1001].bad_rate < 1


def test_domains_by_suffix_rules(spark):
    """Longest rule, wildcards, exceptions and comments against plain Python, on hosts of all kinds."""
    lines = ["com", "uk", "CO.UK", "// a comment", "", None, "*.ck", "!www.ck", "host.net", "net", "com", "a.b.c.d  "]
    rules = {x.split()[0].lower() for x in lines if x and not x.startswith("//")}

    def domain(host):
        labels, best = host.split("."), (False, 1)
        for i in range(1, len(labels) + 1):
            end = ".".join(labels[-i:])
            if end in rules:
                best = max(best, (False, i))
            if f"*.{end}" in rules and i < len(labels):
                best = max(best, (False, i + 1))
            if f"!{end}" in rules:
                best = max(best, (True, i - 1))
        return ".".join(labels[-best[1] - 1 :])

    rng = random.Random(5)
    pool = ["com", "uk", "co", "ck", "www", "host", "net", "a", "b", "c", "d", ""]
    hosts = {"", "com", "x.com", "co.uk", "x.y.co.uk", "www.ck", "x.www.ck", "x.ck", "y.x.ck", "ck", "u.host.net", "v.u.host.net", "q.a.b.c.d", ".".join(["x"] * 20_000) + ".co.uk"}
    hosts |= {".".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(400)}
    made = spark.createDataFrame([(h, 1, 0) for h in hosts], "host string, n long, bad long").repartition(3)
    for use in (lines, []):
        table_ = spark.createDataFrame([(x,) for x in use], "suffix string")
        rules = rules if use else set()
        assert sorted(tuple(r) for r in urls.with_domains(made, table_).collect()) == sorted((h, 1, 0, domain(h)) for h in hosts)


def test_blocks_at_every_level(spark):
    """Hosts, domains and suffixes that stand out are blocked by the posterior bound, also where a host has no labels."""
    pages, outcomes = [], []

    def add(host, n, bad=None):
        for _ in range(n):
            if bad is not None:
                outcomes.append((len(pages), bad))
            pages.append((len(pages), f"https://{host}/p"))

    for i in range(60):
        add(f"www.fine{i}.com", 20, 0)
    add("bad.mixed.com", 60, 1)
    add("good.mixed.com", 60, 0)
    for i in range(12):
        add(f"h{i}.evil.com", 20, 1)
        add(f"www.d{i}.free.zone", 20, 1)
    for host in ("new.evil.com", "www.new.free.zone", "new.fine1.com"):
        add(host, 2)
    made = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    found = spark.createDataFrame(outcomes, "page_id long, bad int")
    lists = spark.createDataFrame([("com",), ("zone",), ("free.zone",)], "suffix string")
    judged = urls.filter_urls(made, found, rules=(), suffixes=lists).select("host", "verdict").distinct().collect()
    verdicts = {r.host: r.verdict for r in judged}
    assert len(judged) == len(verdicts)
    blocked = {h for h, v in verdicts.items() if v == "block"}
    assert blocked == {"bad.mixed.com", "new.evil.com", "www.new.free.zone", *(f"h{i}.evil.com" for i in range(12)), *(f"www.d{i}.free.zone" for i in range(12))}


def test_media(spark, docs, texts):
    stored = media.store_audio(docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload")))
    for r in media.read_audio(stored).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.payload == raw + bytes(-len(raw) % 64 or (0 if raw else 64)) and r.crc_failed == 0 and r.skipped_bytes == 0 and r.vbr_table_ok
        assert r.duration_s == r.frames * 1152 / 32000 and len(r.seek_offsets) == r.frames
    digest = media.read_audio(stored, digest_only=True).where("doc_id = 0").first()
    assert digest.payload_sha256 == hashlib.sha256(texts[0].encode() + bytes(-len(texts[0].encode()) % 64)).hexdigest()


def test_media_survives_damage():
    payload = bytes(range(256)) * 30
    stream = media.write_stream(payload)
    assert media.read_stream(stream).payload == payload
    at = media.read_stream(stream).offsets[2]
    broken = bytearray(stream)
    broken[at + 8] ^= 0x40  # side information no longer fits its checksum
    s = media.read_stream(b"\xff\xfbjunk" + bytes(broken) + b"TAG" + b"name".ljust(125, b"\x00"))
    assert s.failed == 1 and s.skipped > 0 and len(s.offsets) == len(media.read_stream(stream).offsets) - 1 and s.tags["TIT2"] == "name"
    assert media.read_stream(b"").header is None and media.read_stream(b"\xff" * 100).offsets == []
    h = media.parse_header(bytes((0xFF, 0xFB, 0x92, 0x00)))
    assert (h.kbps, h.rate, h.size, h.channels, h.side) == (128, 44100, 418, 2, 32)


def plain_frames(n, kbps_index=9, head=0xFB, fill=b"\x00"):
    """Frames of MPEG-1 Layer III, 44.1 kHz, stereo, without checksums, built by hand."""
    raw = bytes((0xFF, head, kbps_index << 4, 0x00))
    return [raw + fill * (media.parse_header(raw).size - 4) for _ in range(n)]


def test_media_resynchronises():
    # junk with bytes like a header between frames without checksums
    junk = b"xy" + bytes((0xFF, 0xFB, 0x90, 0x00)) + b"z" * 300
    a, b = b"".join(plain_frames(10)), b"".join(plain_frames(10))
    s = media.read_stream(a + junk + b)
    assert len(s.offsets) == 20 and s.skipped == len(junk) and s.offsets[10] == len(a) + len(junk) and s.samples == 20 * 1152
    # a damaged protected frame whose payload holds a header of the same stream
    payload = (b"\x11" * 700 + bytes((0xFF, 0xFA, 0x98, 0xC0)) + b"\x22" * 700) * 4
    stream = media.write_stream(payload)
    whole = media.read_stream(stream)
    broken = bytearray(stream)
    broken[whole.offsets[1] + 10] ^= 1
    s = media.read_stream(bytes(broken))
    assert s.offsets == [o for i, o in enumerate(whole.offsets) if i != 1] and s.failed == 1 and s.checked == len(whole.offsets) + 1
    # a header at the very end of the data, cut short
    s = media.read_stream(a + plain_frames(1)[0][:100])
    assert len(s.offsets) == 10 and s.skipped == 100
    # other streams' headers are damage
    assert len(media.read_stream(a + b"".join(plain_frames(3, head=0xF3)) + b).offsets) == 20
    for cut in range(0, len(stream), 97):
        assert len(media.read_stream(stream[cut:]).offsets) <= len(whole.offsets)


def test_media_reads_tables_of_other_writers():
    body = [f for i in range(200) for f in plain_frames(1, kbps_index=(9, 11, 5)[i % 3])]
    first = bytearray(plain_frames(1)[0])
    size = len(first) + sum(map(len, body))
    starts = [len(first) + sum(map(len, body[:i])) for i in range(200)]

    def xing(flags, frames=200, total=size, toc=None, lame=b""):
        toc = toc if toc is not None else bytes(min(255, 256 * starts[2 * i] // size) for i in range(100))
        parts = [frames.to_bytes(4, "big")] * (flags & 1) + [total.to_bytes(4, "big")] * (flags >> 1 & 1) + [toc] * (flags >> 2 & 1) + [b"\0\0\0\x50"] * (flags >> 3 & 1)
        data = b"Xing" + flags.to_bytes(4, "big") + b"".join(parts) + lame
        out = bytearray(first)
        out[36 : 36 + len(data)] = data
        return media.read_stream(bytes(out) + b"".join(body))

    for flags in range(16):
        s = xing(flags)
        assert s.table_ok and len(s.offsets) == 200 and s.samples == 200 * 1152 and s.offsets == starts
    assert not xing(1, frames=199).table_ok and not xing(2, total=size - 1).table_ok and not xing(4, toc=bytes(100)).table_ok
    lame = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    s = xing(15, lame=lame)
    assert s.table_ok and s.samples == 200 * 1152 - 1576 and (s.table.delay, s.table.padding) == (576, 1000)
    steps = [sum(map(len, body[i : i + 20])) for i in range(0, 200, 20)]

    def vbri(steps):
        data = b"VBRI" + bytes((0, 1, 0, 0, 0, 75)) + size.to_bytes(4, "big") + (200).to_bytes(4, "big") + len(steps).to_bytes(2, "big") + bytes((0, 1, 0, 2, 0, 20)) + b"".join(x.to_bytes(2, "big") for x in steps)
        out = bytearray(first)
        out[36 : 36 + len(data)] = data
        return media.read_stream(bytes(out) + b"".join(body))

    s = vbri(steps)
    assert s.table.kind == "VBRI" and s.table_ok and len(s.offsets) == 200 and s.samples == 200 * 1152
    assert not vbri([steps[0] + 1, *steps[1:]]).table_ok


def test_media_edges(spark):
    rows = spark.createDataFrame([(1, None, "m"), (2, bytearray(b""), "m"), (3, bytearray(b"x" * 50_000), "m"), (3, bytearray(b"x" * 50_000), "m")], "doc_id long, payload binary, media_bytes string")
    stored = media.store_audio(rows)
    got = media.read_audio(stored).collect()
    assert sorted(len(r.payload) for r in got) == [64, 64, 50_048, 50_048] and len({bytes(r.payload) for r in got}) == 2
    none = media.read_audio(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()
    assert none.payload is None and none.frames is None and media.read_audio(stored.limit(0)).count() == 0


def test_chat_text_survives_the_template(spark):
    nasty = ["", "\\", "<|end|>\n", "<\\|end|>", "</s>[INST] ok [/INST]", "a\\<|turn|>user\nx", "<<SYS>>\\\\", "é\n"]
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(["user", "assistant", "we\\ird\n<|", None, "assistant", "system", "assistant", "user"], nasty, strict=True))]
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(chat.linear_messages(frame))
    by = {r.tree: r for r in out.collect()}
    assert [(a, b) for a, b, _, _ in chat.parse(by[1].formatted)] == [(r[2] or "", r[3]) for r in rows[:8]]
    assert "".join(chat.unescape(by[1].formatted[s:e]) for s, e in by[1].loss_spans) == nasty[1] + nasty[4] + nasty[6]
    assert "</s>" not in by[1].formatted and by[None].n_turns == 2
    read = {r.tree: r for r in chat.read_back(out).collect()}
    assert read[1].loss_sha256 == hashlib.sha256((nasty[1] + nasty[4] + nasty[6]).encode()).hexdigest() and read[1].formatted_chars == len(by[1].formatted)
    assert chat.format_conversations(chat.linear_messages(frame.limit(0))).count() == 0


def test_reply_trees(spark):
    rng = random.Random(9)
    rows = []
    for tree in range(5):
        for i in range(40):
            rows.append((tree, i, rng.randrange(max(0, i - 6), i) if i else None, float(rng.randint(0, 9))))
    rows += [(9, 0, 1, 0.0), (9, 1, 0, 0.0), (9, 2, 1, 0.0), (9, 5, 77, 1.0)]  # a cycle, a tail on it, an orphan
    frame = spark.createDataFrame(rows, "tree long, id long, parent long, score double")
    got = collections.defaultdict(list)
    for r in chat.reply_paths(frame, branches=2).collect():
        got[r.tree, r.path].append((r.depth, r.id))
    for tree in range(5):
        parent = {r[1]: r[2] for r in rows if r[0] == tree}
        score = {r[1]: r[3] for r in rows if r[0] == tree}
        paths = []
        for leaf in set(parent) - set(parent.values()):
            p = [leaf]
            while parent[p[-1]] is not None:
                p.append(parent[p[-1]])
            paths.append((-sum(score[i] for i in p) / len(p), leaf, p[::-1]))
        paths.sort()
        for rank in (1, 2):
            assert [i for _, i in sorted(got[tree, rank])] == paths[rank - 1][2]
    assert sorted(got[9, 1]) == [(1, 5)] and (9, 2) not in got


def test_importance(spark):
    rng = random.Random(3)
    good_words, bad_words = [f"g{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        good = i % 4 != 0
        rows.append((i, " ".join(rng.choice(good_words if good or rng.random() < 0.3 else bad_words) for _ in range(60)), "x"))
        if i % 2 or i % 8 == 0:
            labels.append((i, good))
    docs_ = spark.createDataFrame([*rows, (None, None, "x"), (5000, "", "x")], "doc_id long, text string, extra string")
    labs = spark.createDataFrame(labels, "doc_id long, good boolean")
    keyed, least = importance.classify(docs_, labs, buckets=1 << 12)
    kept = {r.doc_id for r in keyed.where(F.col("_key") >= least).collect()}
    unseen = [i for i in range(1200) if i not in dict(labels)]
    assert sum((i in kept) == (i % 4 != 0) for i in unseen) >= 0.93 * len(unseen)
    assert sum(i in kept for i in unseen if i % 4) >= 0.98 * sum(1 for i in unseen if i % 4)
    all_kept, bound = importance.classify(docs_, labs.limit(0), buckets=1 << 8)
    assert bound == -math.inf and all_kept.count() == 1202


def brute_keys(made, labels, fit, noise, buckets):
    """(log weight, key) of each text by plain Python; ``labels``: good or not by number, ``fit``: numbers the models may see."""
    import xxhash

    odd = 0x9E3779B97F4A7C15

    def mix(start, values):
        for v in values:
            start = (start ^ v) * odd % 2**64
            start ^= start >> 29
        return start

    lists = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in made]

    def grams(words):
        h = [xxhash.xxh3_64_intdigest(w) for w in words]
        return [(x >> 7) % buckets for x in h] + [(mix(3, p) >> 7) % buckets for p in zip(h, h[1:], strict=False)]

    def stem(w):
        bare = w.strip(".,;:!?()[]{}\"'*_") or w
        return (xxhash.xxh3_64_intdigest(bare[:6]) >> 7) % (buckets // 2)

    model = [i for i in range(len(made)) if i in fit and labels.get(i)]
    own_grams = [grams(w) for w in lists]
    own_stems = [[stem(w) for w in words] for words in lists]
    raw, target = collections.Counter(x for g in own_grams for x in g), collections.Counter(x for i in model for x in own_grams[i])
    in_all, in_model = collections.Counter(x for o in own_stems for x in set(o)), collections.Counter(x for i in model for x in set(own_stems[i]))

    def ratio(k):
        share = (raw[k] + 1) / (raw.total() + buckets)
        return math.log((target[k] + share * buckets) / (target.total() + buckets)) - math.log(share)

    def cost(x):
        most = in_model[x] + 3 * math.sqrt(in_model[x] + 1) + 1
        return min(0.0, math.log(most / (in_all[x] * len(model) / len(made) + 1)))

    out = []
    for own, g, u in zip(own_stems, own_grams, noise, strict=True):
        costs = [cost(x) for x in own]
        sums = [0.0, *itertools.accumulate(costs)]
        worst = min((sums[min(len(costs), p + 200)] - sums[p] for p in range(len(costs))), default=0.0)
        weight = 200 * sum(map(ratio, g)) / (len(g) + 20) + 8 * worst
        out.append((weight, weight - math.log(-math.log(u))))
    return out


def brute_kept(keys, labels, fit):
    """Whether each key is kept: of the quantiles of held-out good keys the one with the fewest wrong verdicts is the cut."""
    good = sorted(keys[i] for i in labels if labels[i] and i not in fit)
    bad = [keys[i] for i in labels if not labels[i] and i not in fit]
    cuts = np.quantile(good, np.linspace(0.005, 0.2, importance.CUTS))
    wrong = [sum(x < c for x in good) + sum(x >= c for x in bad) for c in cuts]
    return [k >= cuts[int(np.argmin(wrong))] for k in keys]


def noise_of(frame):
    """The hashed number of each row in order of doc_id, and the doc_ids of labels that the models may see."""
    rows = frame.selectExpr("doc_id", "(pmod(xxhash64('resample', doc_id, text), 1L << 40) + 0.5) / (1L << 40) as u", "pmod(xxhash64(doc_id, 'half'), 2) = 0 as fit").orderBy("doc_id").collect()
    return [r.u for r in rows], {r.doc_id for r in rows if r.fit}


def test_log_weights_and_keys_by_brute_force(spark):
    """Ratios, costs, weights, noise and k, counted with plain Python over a small fixture."""
    rng, buckets = random.Random(13), 1 << 10
    made = [None, "", "one", *(" ".join(rng.choice(["a", "B", "cc", f"w{rng.randrange(40)}", "x."]) for _ in range(rng.randint(2, 400))) for _ in range(80))]
    labels = {i: i % 3 != 0 for i in range(0, len(made), 2)}
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    keyed, least = importance.classify(frame, spark.createDataFrame(list(labels.items()), "doc_id long, good boolean"), buckets=buckets)
    got = {r.doc_id: r for r in keyed.collect()}
    noise, fit = noise_of(frame)
    assert {i for i, r in got.items() if r._fit} == fit & set(labels) and {i: r._good for i, r in got.items() if r._good is not None} == labels
    want = brute_keys(made, labels, fit, noise, buckets)
    for i, (weight, key) in enumerate(want):
        assert got[i]._log_weight == pytest.approx(weight, abs=1e-2) and got[i]._key == pytest.approx(key, abs=1e-2)
    assert [got[i]._key >= least for i in range(len(made))] == brute_kept([got[i]._key for i in range(len(made))], labels, fit)


def test_importance_of_a_short_bad_passage(spark):
    rng = random.Random(4)
    plain, insults = [f"w{i}" for i in range(300)], ["idiot", "moron.", "scum", "Loser"]
    rows, labels = [], []
    for i in range(1600):
        words = [rng.choice(plain) for _ in range((40, 200, 1000)[i % 3])]
        if i % 8 == 0:
            p = rng.randrange(len(words) - 4)
            words[p : p + 4] = rng.sample(insults, 4)
        rows.append((i, " ".join(words)))
        if i % 16 < 10:
            labels.append((i, i % 8 != 0))
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed, least = importance.classify(docs_, spark.createDataFrame(labels, "doc_id long, good boolean"), buckets=1 << 14)
    kept = {r.doc_id for r in keyed.where(F.col("_key") >= least).collect()}
    for length in range(3):
        bad = [i for i in range(length, 1600, 3) if i % 8 == 0]
        fine = [i for i in range(length, 1600, 3) if i % 8]
        assert sum(i in kept for i in bad) <= 0.1 * len(bad) and sum(i in kept for i in fine) >= 0.97 * len(fine)


def test_worst_windows():
    rng = random.Random(6)
    texts_ = [[-rng.randrange(5) for _ in range(n)] for n in (0, 1, 9, 0, 10, 11, 60, 0)]
    doc = [i for i, t in enumerate(texts_) for _ in t]
    got = importance.worst_windows(np.array([c for t in texts_ for c in t]), np.array(doc), len(texts_), window=10)
    assert got.tolist() == [min((sum(t[p : p + 10]) for p in range(len(t))), default=0) for t in texts_]


def test_kth_largest(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 1e9]) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "_key double")
    ranked = sorted(values, reverse=True)
    for k in (1, 10, 1200, 2999):
        assert importance.kth_largest(frame, k) == ranked[k - 1]
    assert importance.kth_largest(frame, 3000) == -math.inf


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    kept = {}
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs_.columns
    for name, stage in corpus_pipeline.STAGES:
        docs_ = corpus_pipeline.materialize(stage(spark, docs_, sf), "test")
        kept[name] = docs_.select("doc_id").collect()
        assert name == "packing" or docs_.columns == columns
    counts = [len(v) for v in kept.values()]
    assert counts[0] >= counts[1] == counts[2] > 0
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    first = {r.doc_id for r in kept["quality classifier"]}
    assert len(clean & first) >= 0.9 * len(clean)
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["source mixing"]}


def brute_copies(rows):
    """How often the mix takes each of ``rows`` (doc_id, text, source)."""
    unit = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:12], 16) / 16**12
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by = collections.defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        by[s].append(i)
    names = sorted(by, key=lambda s: (s is None, s))
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: sum(size[i] for i in by[s]) for s in names}
    fixed = set()
    while True:
        level = (sum(size) - sum(3 * total[s] for s in fixed)) / max(1, sum(weight[s] for s in names if s not in fixed))
        over = {s for s in names if s not in fixed and level * weight[s] > 3 * total[s]}
        if not over:
            break
        fixed |= over
    out = [0] * len(rows)
    for s in names:
        rate = (3 * total[s] if s in fixed else level * weight[s]) / total[s] if total[s] else 0.0
        f, phase, before = rate - math.floor(rate), unit(f"mix:{s if s is not None else chr(0) + 'null'}"), 0
        bins = collections.defaultdict(list)
        for i in by[s]:
            bits = max(1, size[i].bit_length())
            bins[bits, size[i] >> bits - 4 if bits > 4 else size[i]].append(i)
        for b in sorted(bins):
            draws = {i: unit(f"mix:{rows[i][0] if rows[i][0] is not None else ''}:{rows[i][1] or ''}") for i in bins[b]}
            more = math.floor(phase + (before + len(draws)) * f) - math.floor(phase + before * f)
            before += len(draws)
            done, threshold = 0, 0.0
            for part in range(256):
                n = sum(math.floor(d * 256) == part for d in draws.values())
                if done < more <= done + n:
                    threshold = (part + (more - done) / n) / 256
                done += n
            for i, d in draws.items():
                out[i] = math.floor(rate) + (d < threshold)
    return out


def test_pipeline_by_brute_force(spark, texts, tmp_path):
    """run() against plain Python, stage by stage, over copies, near copies, passages, toxic rows and nulls."""
    import corpus_pipeline

    rng = random.Random(21)
    plain = [f"p{i}" for i in range(400)]
    made = [*texts, *(" ".join(rng.choice(plain) for _ in range(rng.randint(30, 250))) for _ in range(240))]
    bad = {i for i in range(len(texts), len(made)) if i % 5 == 0}
    for i in bad:
        words = made[i].split()
        for p in range(0, len(words), 3):
            words[p] = rng.choice(["scum", "idiot!", "junk#", "spam"])
        made[i] = " ".join(words)
    made += [made[-1], made[-2], made[-3] + " tail"]
    labels = {i: i not in bad for i in range(len(texts), len(made), 2)} | {i: i not in bad for i in bad if i % 3}
    sources = [None if i % 13 == 0 else f"s{i % 4}" for i in range(len(made))]
    docs_ = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, (t, s) in enumerate(zip(made, sources, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    docs_.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g or i % 2), int(not g)) for i, g in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    noise, fit = noise_of(docs_)
    keys = [k for _, k in brute_keys(made, labels, fit, noise, importance.BUCKETS)]
    kept = [i for i, keep in enumerate(brute_kept(keys, labels, fit)) if keep]
    assert len(bad & set(kept)) <= 0.1 * len(bad) and len(kept) > 150
    _, names = brute_components([made[i] for i in kept], 80)
    kept = [i for p, i in enumerate(kept) if names[p] == p]
    words, first = {i: WORD.findall(made[i] or "") for i in kept}, {}
    for i in kept:
        for p in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][p : p + 13]), i)
    rows = []
    for i in kept:
        gone = {q for p in range(len(words[i]) - 12) if first[tuple(words[i][p : p + 13])] < i for q in range(p, p + 13)}
        rows.append((i, " ".join(w for q, w in enumerate(words[i]) if q not in gone) if gone else made[i], sources[i]))
    library = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), "word").library
    want = collections.Counter()
    for (i, t, _), times in zip(rows, brute_copies(rows), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, n, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += times
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


CLASHING = ["_id", "_good", "_fit", "_log_weight", "_key", "_s", "_t", "_s_size", "_mix_size", "_cut_starts", "_cut_text", "row", "node", "gone", "gone_row", "span_doc", "spans", "draw", "bin", "part", "threshold", "c0", "c1", "size", "copies", "seeds", "digest", "uid", "target", "label", "key"]


def odd_docs(spark, rows):
    """Rows with null ids and texts, repeated rows, a very long text and columns named like those that operators use inside."""
    extra = {f"`{c}` long": 7 for c in CLASHING}
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(extra)
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, *extra.values()) for i, t, s in rows], ddl)


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    long, base = say(60_000), say(120)
    rows = [(None, base, "a"), (None, None, None), (1, base, "a"), (1, base, "a"), (1, say(40), "b"), (2, base + " end", "b"), (3, "", None), (4, None, "a"), (5, long, "b"), (6, " ".join(["same"] * 300), "b"), (6, " ".join(["same"] * 300), "b"), *((i, say(50), "c") for i in range(10, 30))]
    docs_ = odd_docs(spark, rows)
    spark.createDataFrame([(i, i % 2, 0) for i in range(10, 20)] + [(None, 1, 0), (10, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs_, str(tmp_path)), "odd")
        assert out.columns == docs_.columns and out.where("_key <> 7 or c0 <> 7").isEmpty(), name
        got[name] = collections.Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
        none = corpus_pipeline.materialize(stage(spark, docs_.limit(0), str(tmp_path)), "odd")
        assert none.columns == docs_.columns and none.count() == 0, name
    near = got["near-dedup"]
    # of the rows of one group one stays, with the least id; the row with that id and another text is a document of its own
    assert near[1, base] == 1 and near[1, rows[4][1]] == 1 and near[2, base + " end"] == 0 and near[6, rows[9][1]] == 1 and near[None, base] == near[None, None] == 1
    assert got["substring dedup"][5, long] == 1 and got["substring dedup"][1, base] == 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs_, str(tmp_path)).collect()
    assert sum(r.length for r in pieces if r.doc_id == 5) > 60_000 and sum(r.doc_id is None for r in pieces) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs_.limit(0), str(tmp_path)).count() == 0


def test_other_operators_on_odd_rows(spark):
    twice = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "x" * 200_000), (None, None, None, None)]
    rows = spark.createDataFrame(twice, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(3))
    read = {r.tree: r for r in chat.read_back(chat.format_conversations(chat.linear_messages(rows))).collect()}
    assert read[1].n_turns == 3 and read[1].loss_chars == 200_000 and read[None].n_turns == 1
    pages = spark.createDataFrame([(1, "http://a.com/" + "p" * 100_000, 1, "h"), (1, "http://a.com/x", 1, "h"), (None, None, None, "h")], "page_id long, url string, bad int, host string")
    got = urls.filter_urls(pages, pages.select("page_id", "bad")).collect()
    assert len(got) == 3 and {r.host for r in got} == {"a.com", ""} and urls.filter_urls(pages.limit(0), pages.select("page_id", "bad").limit(0)).count() == 0
