"""Operators against plain versions that share no table, slice or batch with them."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from quarry.llm import fingerprint, langid, pieces, quality, suffix_tree, toxicity, url_filter  # noqa: E402
from quarry.llm.kernel import Kernel, mix, shingles  # noqa: E402
from quarry.session import table  # noqa: E402
from tests.llm.test_llm import DOC, LOWER, ODD, SF, texts, words  # noqa: E402

SEPARATORS = " \t\n\v\f\r"
MIXED = ["Ünïcode — straße", "日本語のテキスト、日本", "a🙂b🙂c🙂d", "é" * 30, "Ab " * 40]


def plain(text, marks):
    """Characters, A-Z lower-cased, marks as one."""
    return [" " if c in marks else c for c in (text or "").translate(LOWER)]


def grams(text, n, marks=SEPARATORS):
    c = plain(text, marks)
    return ["".join(c[i : i + n]) for i in range(len(c) - n + 1)]


def test_points_are_characters():
    kernel = Kernel()
    rows = [*MIXED, "", "plain", "\x7f\x80ÿĀ߿ࠀ￿𐀀"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(r.encode()) for r in rows]))
    v, first = kernel.points(data, at)
    assert np.diff(first).tolist() == [len(r) for r in rows]
    names = {}
    for c, x in zip("".join(rows).translate(LOWER), v.tolist(), strict=True):
        assert names.setdefault(x, c) == c or {names[x], c} <= set(SEPARATORS)
    assert len(names) == len({" " if c in SEPARATORS else c for c in "".join(rows).translate(LOWER)})


# --- 1 ---


def unigram_file(path, entries, prefix):
    """A model file of the unigram kind, written by hand: (text, score, type) of every piece."""
    import struct

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    def text(field, x):
        return number(field << 3 | 2) + number(len(x)) + x

    body = b"".join(text(1, text(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + number(3 << 3) + number(k)) for p, s, k in entries)
    body += text(2, number(3 << 3) + number(1) + number(35 << 3) + number(int(any(k == 6 for _, _, k in entries)))) + text(3, text(1, b"identity") + number(3 << 3) + number(int(prefix)) + number(4 << 3) + number(0) + number(5 << 3) + number(1))
    with open(path, "wb") as f:
        f.write(body)


@pytest.mark.parametrize("spelled", [False, True])
def test_unigram_models_equal_the_library(spark, tmp_path, spelled):
    import sentencepiece

    rng = np.random.default_rng(2)
    own = sorted({"".join(rng.choice(list("abc▁é"), int(rng.integers(1, 5)))) for _ in range(60)} | set("abc▁"))
    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    entries += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if spelled else []
    entries += [(p, -float(rng.integers(20, 4000)) / 97 - len(entries) * 1e-4 - i * 1e-3, 1) for i, p in enumerate(own)]
    path = str(tmp_path / "m.model")
    unigram_file(path, entries, True)
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.read_model(path)
    rows = [(i, "".join(rng.choice(list("abc é日x"), int(rng.integers(0, 60)), p=[0.25, 0.2, 0.2, 0.15, 0.1, 0.05, 0.05]))) for i in range(80)] + [(100, None), (101, ""), (102, "日日日"), (103, "x日x ab 日")]
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        want = library.encode(t or "")
        # the same pieces in another order cost as much: which of two such paths the library takes depends on its rounding
        assert got[i] == want or sorted(got[i]) == sorted(want) and library.decode(got[i]) == library.decode(want), (i, t)
    assert sum(got[i] == library.encode(t or "") for i, t in rows) > 0.9 * len(rows)


# --- 3 ---

MARKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def test_language_by_sets_of_ngrams(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").union(spark.createDataFrame([(7000 + i, t * 4, "ja" if i % 2 else "xx") for i, t in enumerate(MIXED)], "doc_id long, text string, lang string"))
    rows = docs.collect()
    known = [r for r in rows if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    own = lambda t: [g for g in grams(t, 4, MARKS) if g.count(" ") <= 1]
    count, in_docs, size, seen = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.Counter(), collections.Counter()
    for r in known:
        g = own(r["text"])
        count[r["lang"]].update(g), in_docs[r["lang"]].update(set(g))
        size[r["lang"]] += len(g)
        seen[r["lang"]] += 1
    filters = {x: {g for g, c in count[x].items() if c >= max(1, 2e-6 * size[x]) and (in_docs[x][g] >= 2 or seen[x] < langid.FEW)} for x in count}
    model = langid.train(docs)
    assert model.languages == sorted(filters)
    best, score, share, number = model.predict(pa.array([r["text"] for r in rows], pa.string()), Kernel(extra_separators=True))
    for i, r in enumerate(rows):
        g = own(r["text"])
        have = {x: sum(k in f for k in g) for x, f in filters.items()}
        assert number[i] == len(g)
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert best[i] == -1 and score[i] == 0
            continue
        top = sorted(have.values(), reverse=True)
        if top[0] - (top[1] if len(top) > 1 else 0) > 0.02 * len(g) + 1:
            assert model.languages[best[i]] == max(have, key=have.get), r["doc_id"]
            assert share[i] == pytest.approx(top[0] / len(g), abs=0.02)
            assert score[i] == pytest.approx((top[0] + 1) / (top[0] + top[1] + 2), abs=0.03)


# --- 5, 6 ---


def buckets_of(one, make):
    """Bucket of a single n-gram, computed from its text alone."""
    data = np.frombuffer(one.encode(), np.uint8)
    return make(data, np.array([0, len(data)]))


def test_toxicity_by_sum_of_weights(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model, kernel = toxicity.train(docs, labels), Kernel()
    sample = [r["text"] for r in docs.orderBy("doc_id").limit(25).collect()] + [t for _, t, *_ in ODD if t is None or len(t) < 1000] + MIXED
    got = model.score(pa.array(sample, pa.string()), kernel)
    bucket = {}
    for t, s in zip(sample, got):
        own = set()
        for n in model.sizes:
            for g in set(grams(t, n)):
                if g not in bucket:
                    bucket[g] = int(buckets_of(g, lambda d, o, n=n: toxicity.ngram_buckets(d, o, kernel, (n,)))[1][0])
                own.add(bucket[g])
        z = model.bias + sum(float(model.weights[b]) for b in own)
        assert s == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-5)


def test_quality_by_mean_of_vectors(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model, kernel = quality.train(docs, labels), Kernel()
    sample = [r["text"] for r in docs.orderBy("doc_id").limit(25).collect()] + [t for _, t, *_ in ODD if t is None or len(t) < 1000] + MIXED
    got = model.score(pa.array(sample, pa.string()), kernel)
    shift = np.uint64(64 - quality.BITS)
    seen = {}

    def gram(g):
        if g not in seen:
            v, at = kernel.points(np.frombuffer(g.encode(), np.uint8), np.array([0, len(g.encode())]))
            seen[g] = int(quality.ngrams(v, at, len(g))[1][0] >> shift)
        return seen[g]

    def word(w):
        data = np.frombuffer(w.encode(), np.uint8)
        return kernel.word_hashes(data, np.array([0, len(data)]))[0]

    for t, s in zip(sample, got):
        w = [word(x) for x in words(t)]
        values = [float(model.table[int(x[0] >> shift)]) for x in w]
        values += [float(model.table[int(quality.ngrams(np.concatenate([a, b]), np.array([0, 2]), 2)[1][0] >> shift)]) for a, b in zip(w, w[1:])]
        for n in model.sizes:
            values += [float(model.table[gram(g)]) for g in grams(t, n)]
        z = model.bias + (sum(values) / len(values) if values else 0.0)
        assert s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_conflicting_and_odd_labels(spark):
    docs = spark.createDataFrame([(i, ("vile nasty scum " if i % 2 else "kind gentle folk ") * 5) for i in range(200)] + [(None, "x")], "doc_id long, text string")
    once = [(i, i % 2) for i in range(200)]
    twice = [(i, 0) for i in range(1, 200, 2)] + [(i, None) for i in range(0, 200, 4)] + [(i, 7) for i in range(5)] + [(None, 1)]
    for train, arrays in ((toxicity.train, lambda m: (m.weights, m.bias)), (quality.train, lambda m: (m.table, m.bias))):
        name = "toxic" if train is toxicity.train else "quality"
        one, two = (arrays(train(docs, spark.createDataFrame(rows, f"doc_id long, {name} int"))) for rows in (once, once + twice))
        assert (one[0] == two[0]).all() and one[1] == two[1]
        small = train(docs, spark.createDataFrame(once, f"doc_id long, {name} int"), most_bytes=2000)
        assert arrays(small)[0].any()
    scored = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(once, "doc_id long, toxic int")))
    assert scored.count() == 201 and scored.where("doc_id is null").first()["held_out"] is True


# --- 8 ---


def test_fingerprint_bins_and_densification(spark):
    maker, kernel = fingerprint.Fingerprinter(), Kernel()
    docs = table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").limit(30).union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate([*MIXED, "one", "", "a b c d e f"])], "doc_id long, text string"))
    want = texts(docs)
    rows = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}

    def plain_print(text):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, _ = shingles(*kernel.word_hashes(data, np.array([0, len(data)])))
        if not len(hashes):
            return ""
        least = {}
        for h in hashes.tolist():
            least[h >> 56] = min(h, least.get(h >> 56, 1 << 64))
        out = []
        for b in range(fingerprint.BINS):
            at = b if b in least else min(least, key=lambda j: maker.rank[b, j])
            out.append(int(mix(np.array([least[at]], np.uint64))[0]) & 255)
        return bytes(out).hex()

    order = sorted(want, reverse=True)
    for i, k in enumerate(order):
        following = want[order[(i + 1) % len(order)]] or ""
        a = want[k] or ""
        n = len(a) // 2
        new = a[: len(a) - n] + following[:n]
        r, own, other, nxt = rows[k], plain_print(a), plain_print(new), plain_print(following)
        assert (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (own, other, hashlib.sha256(new.encode()).hexdigest())

        def like(x, y):
            if not x or not y:
                return float(x == y)
            same = sum(p == q for p, q in zip(bytes.fromhex(x), bytes.fromhex(y))) / 256
            return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))

        assert r["near_edited"] == pytest.approx(like(own, other)) and r["near_next"] == pytest.approx(like(own, nxt))


# --- 9 ---


def brute_language_model(train, depth=suffix_tree.DEPTH, least=suffix_tree.LEAST, cost=suffix_tree.COST):
    """A function from a text to its log10 probability, by dictionaries of word tuples."""
    start, end = "\0start", "\0end"
    of = lambda t: [start, *words(t), end]
    counts = [collections.Counter() for _ in range(depth + 2)]
    for t in train:
        s = of(t)
        for n in range(1, depth + 2):
            counts[n].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    tokens = {k: c for k, c in counts[1].items() if k != (start,)}
    total, once = sum(tokens.values()), sum(c == 1 for c in tokens.values())
    unknown = min(max(once / total, 1 / (total + len(tokens) + 1)), 0.5)
    tree = [None, {k: c for k, c in counts[1].items() if c >= least or k in ((start,), (end,))}]
    for n in range(2, depth + 2):
        tree.append({k: c for k, c in counts[n].items() if c >= least and k[:-1] in tree[n - 1] and k[1:] in tree[n - 1]})
    p, back = {}, {}

    def chance(context, s):
        while context and context not in back:
            context = context[1:]
        if not context:
            return (1 - unknown) * tokens[s,] / total if (s,) in tokens else unknown
        return p[context, s] if (context, s) in p else back[context] * chance(context[1:], s)

    for n in range(1, depth + 1):
        following = collections.defaultdict(list)
        for k, c in tree[n + 1].items():
            following[k[:-1]].append((k[-1], c))
        kept = {}
        for context, nexts in following.items():
            size, kinds = tree[n][context], len(nexts)
            b = (max(size - sum(c for _, c in nexts), 0) + kinds) / (size + kinds)
            lower = {s: chance(context[1:], s) for s, _ in nexts}
            own = {s: (c + b * (size + kinds) * lower[s]) / (size + kinds) for s, c in nexts}
            divergence = sum(x * math.log(x / lower[s]) for s, x in own.items()) + max(1 - sum(own.values()), 0) * math.log(b)
            if size * divergence >= cost * (kinds + 1):
                kept[context] = (b, own)
        for context, (b, own) in kept.items():
            back[context] = b
            p.update({(context, s): x for s, x in own.items()})

    def score(text):
        s = of(text)
        return sum(math.log10(chance(tuple(s[max(0, i - depth) : i]), s[i])) for i in range(1, len(s)))

    return score


def test_weights_leave_one_table(spark):
    import os

    from quarry.session import checkpoint_root

    folder = checkpoint_root(spark).removeprefix("file://")
    docs = spark.createDataFrame([(i, "a b c d a b c d e f") for i in range(20)], "doc_id long, text string")
    counts, stats = suffix_tree.root(docs)
    before = set(os.listdir(folder))
    out = suffix_tree.weights(docs, counts, stats)
    assert set(os.listdir(folder)) - before == {os.path.basename(out.scratch_path)} and out.count() > 0


def test_scoring_leaves_its_result_only(spark, monkeypatch):
    """Tables and broadcasts that outlive a scoring add up from query to query, in the driver's memory too."""
    import os

    from quarry.session import checkpoint_root

    folder, made = checkpoint_root(spark).removeprefix("file://"), []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: made.append(send(sc, value)) or made[-1])
    docs = spark.createDataFrame([(i, "a b c d a b c d e f") for i in range(20)], "doc_id long, text string")
    before = set(os.listdir(folder))
    out = suffix_tree.score(docs)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() == 20
    assert made and not [b for b in made if os.path.exists(b._path)]


def test_tidy_lets_shuffles_go(spark):
    """The listeners' threads hold on to the last event, a query's end, and with it to the query's shuffles."""
    import time

    from quarry.llm.common import tidy
    from quarry.session import stored

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in (str(f) for f in disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in n}
    before = files()
    stored(spark.range(1000).repartition(3, "id"))
    assert files() - before
    tidy(spark)
    until = time.time() + 8
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_language_model_scores_with_one_partition(spark):
    """Few partitions make few ranges of keys; the filters then still get all the bits that they look at."""
    docs = spark.createDataFrame([(i, f"w{i % 50} x{i % 40} y{i % 30} z{i % 20}") for i in range(400)], "doc_id long, text string")
    want = sorted((r["doc_id"], round(r["score"], 9)) for r in suffix_tree.score(docs).collect())
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted((r["doc_id"], round(r["score"], 9)) for r in suffix_tree.score(docs).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_language_model_scores(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(("a b c" if rng.random() < 0.6 else "d E") if rng.random() < 0.7 else f"u{rng.integers(0, 40)}" for _ in range(int(rng.integers(0, 40))))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "new words only here"), (1, "a b c a b c"), (None, "d e d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    score = brute_language_model([t or "" for i, t in rows if not held(i)])
    got = collections.defaultdict(list)
    for r in suffix_tree.score(docs).collect():
        got[r["doc_id"]].append(r["score"])
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(score(t or ""))
    assert set(got) == set(want)
    for i in want:
        assert sorted(got[i]) == pytest.approx(sorted(want[i]), rel=1e-6, abs=1e-9), i


# --- 10 and odd input ---


def test_url_filter_odd_rows_on_the_joined_path(spark):
    rows = [(1, None), (1, None), (2, ""), (2, ""), (None, "http://x.net/es/1"), (3, "http://x.net/es/1"), (3, "http://x.net/es/1"), (4, "http://" + "a" * 5000 + ".com/" + "b/" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"html": F.lit("h"), "rule": F.lit("r"), "token": F.lit("t"), "host": F.lit("z")})
    key = lambda d: sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in d.collect())
    broadcast, joined = key(url_filter.judge(pages)), key(url_filter.judge(pages, most_broadcast=0, salts=2))
    assert broadcast == joined and len(broadcast) == len(rows)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    for name, rows in (("odd", ODD), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, DOC).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (4, 1, 1), (9, None, None), (None, 1, 1)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, ""), (3, "The five words are here the five words are here the five")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = cp.run(spark, folder)
        assert out.count() <= len({r[0] for r in rows}) and (rows or out.count() == 0)


# --- bounds of samples and weights of classes ---


def test_repeated_ids_keep_the_bound(spark):
    from quarry.llm.common import bounded_rows

    rows = [(1, b"x" * 1000 + bytes([i])) for i in range(50)] + [(2, b"y" * 400), (3, b"z" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, f binary").repartition(4)
    for most in (300, 900, 1500, 10_000):
        got = list(bounded_rows(df, ["f"], most))
        assert sum(len(r["f"]) for r in got) <= most and len({r["doc_id"] for r in got}) == len(got)
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3]
    again = list(bounded_rows(df.repartition(7), ["f"], 10_000))
    assert sorted((r["doc_id"], bytes(r["f"])) for r in again) == sorted((r["doc_id"], bytes(r["f"])) for r in got)


def test_the_threshold_does_not_move_with_the_share_of_a_class():
    """Four times the clean rows of the same kind leave the verdicts as they are."""
    toxic, clean = [np.array([1, 2, 9], np.int32)] * 40, [np.array([3, 4, 9], np.int32)] * 60
    few = toxicity.fit_arrays(toxic + clean, np.repeat([1.0, 0.0], [40, 60]), (4, 6))
    many = toxicity.fit_arrays(toxic + clean * 4, np.repeat([1.0, 0.0], [40, 240]), (4, 6))
    for d in (toxic[0], clean[0]):
        assert (few.weights[d].sum() + few.bias > 0) == (many.weights[d].sum() + many.bias > 0)


# --- 9: packed ranges ---


def test_hashes_are_ordered_exactly():
    """Sorting by upper bits alone would leave keys in disorder that differ in their lower bits only."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    keys[:3000] = (keys[:1] & ~np.uint64(7)) + rng.integers(0, 8, 3000).astype(np.uint64)
    order = suffix_tree.ordered(keys)
    assert (keys[order] == np.sort(keys)).all() and (np.sort(order) == np.arange(5000)).all()


def test_filter_holds_its_keys_and_few_others():
    """At a load of an eighth a table with one bit a key would let through an eighth of the others."""
    bits = 4
    keys = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 1 << 18).astype(np.uint64) * np.uint64(2))
    crowded = np.sort(np.random.default_rng(6).integers(0, 1 << 60, 1 << 20).astype(np.uint64))
    found = pa.table({"range": pa.array([0], pa.int32()), "words": pa.array([suffix_tree.segment(crowded, bits)], pa.binary())})
    shut = suffix_tree.Filter(found, bits)
    assert shut.has(crowded).all() and not shut.has(keys[keys >> np.uint64(60) > 0]).any()
    assert shut.has(np.random.default_rng(7).integers(0, 1 << 60, 100_000).astype(np.uint64)).mean() < 0.08
