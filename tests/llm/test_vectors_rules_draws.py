"""Ball k-means, quality rules and importance resampling against plain versions, SQL and odd inputs."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
from quarry.llm import ball_kmeans, quality_rules, resampling  # noqa: E402
from quarry.llm.queries import QUERIES  # noqa: E402
from quarry.session import table  # noqa: E402
from tests.llm.test_llm import DOC, LOWER, ODD, SF  # noqa: E402


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 11 ---


def plain_kmeans(rows, k, rounds, scale, seed=1):
    """rows: (id, whole-number vector). Every vector against every centroid."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        member = collections.defaultdict(list)
        for _, v in rows:
            member[nearest(v)[1]].append(v)
        for i, own in member.items():
            centres[i] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in rows], centres


@pytest.mark.parametrize(("dim", "k", "size", "spread"), [(2, 7, 400, 1000), (3, 5, 300, 3), (64, 4, 60, 1 << 20), (64, 16, 9, 10)])
def test_balls_equal_full_comparison(spark, dim, k, size, spread):
    rng = np.random.default_rng(dim)
    rows = [(int(i) if i % 11 else None, [float(x) for x in rng.integers(-spread, spread, dim)]) for i in range(size)]
    rows += rows[:5]  # repeated rows
    want, centres = plain_kmeans([(i, [math.floor(64 * x) for x in v]) for i, v in rows], k, 3, 64)
    bad = [(1000, None), (1001, rows[0][1][1:]), (1002, [*rows[0][1][1:], None]), (1003, [*rows[0][1][1:], float("nan")]), (1004, [*rows[0][1][1:], float("-inf")]), (1005, [*rows[0][1][1:], 1e300])]
    got, final = ball_kmeans.cluster(spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, cluster int"), k=k, dim=dim)
    assert by_id(got, "vec_id", "cluster", "distance") == sorted(want, key=repr)
    assert final.tolist() == centres
    most = [r["compared"] for r in got.collect()]
    assert max(most) <= min(k, size)
    if dim == 2:
        assert sum(most) < 0.7 * k * len(most)  # cores and annuli leave most centroids out


def test_kmeans_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ball_kmeans.report(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"]
    assert ball_kmeans.report(none).count() == 0
    assert ball_kmeans.report(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op13_importance_resampling"])
def test_query_equals_sql(spark, name):
    from quarry.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    theirs = con.sql(ORACLES[name]).df().astype(object)
    theirs = theirs.where(theirs.notna(), None)
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(theirs.columns)
    assert by_id(got, *columns) == sorted((tuple(x if x is None or isinstance(x, str) else int(x) for x in r) for r in theirs[columns].itertuples(index=False)), key=repr)


# --- 12 ---


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_counts(text):
    w, text = split(text), text or ""
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if split(x)]
    letter = lambda c: "a" <= c.lower() <= "z" and c.isascii() or ord(c) > 127
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_alpha_words": sum(any(map(letter, x)) for x in w), "n_plain_words": sum(bool(re.fullmatch(r"[a-zA-Z'\-\x80-\U0010ffff]*[.,;:!?]?", x)) for x in w), "n_letters": sum(map(letter, text)), "n_upper": sum("A" <= c <= "Z" for c in text), "n_digits": sum("0" <= c <= "9" for c in text), "n_ends": sum(c in ".!?" for c in text),
    }


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t1.|#日", max_size=60), min_size=1, max_size=5))
def test_measures(rows):
    measures = quality_rules.Measures()
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    got = measures.of(data, np.append(0, np.cumsum([len(r.encode()) for r in rows])))
    for i, r in enumerate(rows):
        assert {c: int(got[c][i]) for c in quality_rules.COUNTS} == plain_counts(r)


def plain_votes(m):
    out = []
    for r in quality_rules.RULES:
        n = m[r.denominator]
        x = m[r.numerator] / max(n, 1)
        out.append(0 if n < r.enough else 1 if r.low <= x <= r.high else 2 if x < r.least or x > r.most else 0)
    return out


def plain_em(votes, prior=10.0, good0=0.95, bad0=0.2, limit=0.9999):
    """Document by document; P(good) of each, and of any other votes."""
    p = [0.1 if 2 in v else 0.9 for v in votes]
    for _ in range(500):
        on_good, on_bad = [], []
        for j in range(len(quality_rules.RULES)):
            cast = [(v[j], x) for v, x in zip(votes, p) if v[j]]
            g = (sum(x for y, x in cast if y == 1) + prior * good0) / (sum(x for _, x in cast) + prior)
            b = (sum(1 - x for y, x in cast if y == 2) + prior * bad0) / (sum(1 - x for _, x in cast) + prior)
            on_good.append(min(max(g, 1 - limit), limit))
            on_bad.append(min(max(b, 1 - on_good[-1], 1 - limit), limit))
        share = (sum(p) + prior / 2) / (len(p) + prior)

        def chance(v):
            z = math.log(share / (1 - share)) + sum(math.log(on_good[j] / (1 - on_bad[j])) if y == 1 else math.log((1 - on_good[j]) / on_bad[j]) if y == 2 else 0 for j, y in enumerate(v))
            return 1 / (1 + math.exp(-z))

        before, p = p, [chance(v) for v in votes]
        if max(map(abs, np.subtract(before, p)), default=0) < 1e-12:
            break
    return chance


def test_rules_equal_plain_version(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(7000 + i, " ".join(f"wörd{i}x{j} |" for j in range(60)), "en", "s", 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra)
    rows = {r["doc_id"]: plain_counts(r["text"]) for r in docs.collect()}
    failed = {i: m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] for i, m in rows.items()}
    chance = plain_em([plain_votes(m) for i, m in rows.items() if not failed[i]])
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        m = rows[r["doc_id"]]
        assert [r[c] for c in quality_rules.COUNTS[:5]] == [m[c] for c in quality_rules.COUNTS[:5]]
        p = chance(plain_votes(m))
        assert r["posterior"] == pytest.approx(p, abs=1e-5)
        assert (r["base_failed"], r["kept"]) == (failed[r["doc_id"]], not failed[r["doc_id"]] and p >= 0.5)
    assert not any(r["kept"] for r in got if r["doc_id"] >= 7000)
    assert sum(r["kept"] for r in got) > 0.7 * len(got)


def test_rules_agree_with_labels(spark):
    """No label is read; on sf0.01 the verdict rejects what is labelled 0 and keeps what is labelled 1, as far as the plain limits leave them open."""
    sf = "/root/testdata/sf0.01"
    both = quality_rules.judge(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed and quality is not null").collect()
    good = [r["kept"] for r in both if r["quality"] == 1]
    bad = [not r["kept"] for r in both if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) >= 0.9 * len(bad)


# --- 13 ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBc 1é\n.日", max_size=90), min_size=1, max_size=5), st.integers(1, 4))
def test_features_are_crcs_of_runs(rows, n):
    features = resampling.Features(n, 1000)
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(r.encode()) for r in rows]))
    got = collections.defaultdict(collections.Counter)
    where, bucket, words = features.of(data, at, np.diff(at))
    for r, b in zip(where.tolist(), bucket.tolist()):
        got[r][b] += 1
    for i, r in enumerate(rows):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.translate(LOWER))
        assert words[i] == len(w)
        assert got[i] == collections.Counter(zlib.crc32(" ".join(w[a : a + k]).encode()) % 1000 for k in range(1, n + 1) for a in range(len(w) - k + 1))


def test_crc_of_long_words():
    crc = resampling.Crc()
    texts = [b"a" * n + b"b" for n in (0, 1, 63, 64, 65, 1000, 70_000)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    words = crc.words(data, ends - [len(t) for t in texts], ends)
    assert words.tolist() == [zlib.crc32(t) for t in texts]
    for x in texts:
        got = crc.append(np.full(len(texts), zlib.crc32(x), np.uint32), words, np.array([len(t) for t in texts]))
        assert got.tolist() == [zlib.crc32(x + b" " + t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab é.\n日", max_size=200), st.integers(1, 30), st.integers(0, 3))
def test_chunks_own_each_word_once_and_carry_the_next(text, limit, carry):
    separator = resampling.Kernel(extra_separators=True).sep
    data = np.frombuffer(text.encode(), np.uint8)
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = [m.start() for m in re.finditer(pattern, text.encode())]
    parts = list(resampling.spans(data, separator, limit, carry))
    assert [a for a, _, _ in parts] == [0, *(b for _, b, _ in parts[:-1])][: len(parts)]
    assert not parts or parts[-1][1] == len(data)
    for a, own, end in parts:
        here = [a + m.start() for m in re.finditer(pattern, text.encode()[a:end])]
        assert [x for x in here if x < own] == [x for x in words if a <= x < own]
        assert here == words[words.index(here[0]) :][: len(here)] if here else True
        assert len([x for x in here if x >= own]) == min(carry, len([x for x in words if x >= own]))


def plain_resample(docs, target):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return w, [zlib.crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w, w[1:]))]]

    s, t = (collections.Counter(b for text in texts for b in runs(text)[1]) for texts in ([d[1] for d in docs], target))
    n, m = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        w, f = runs(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[2], r[1]))
    for k, r in enumerate(may[: 25 * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("size", [1 << 16, 200])
def test_resampling_of_odd_rows(spark, size):
    rows = [*ODD, *((20 + i, f"word{i % 3} and é more " * (4 + i), "en", "s", 1, 1, "x", 2) for i in range(40)), (None, "a b c " * 30, "en", "s", 1, 1, "x", 2)]
    target = [None, "", "word1 and more", "Word2 É"]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), chunk_bytes=size)
    assert by_id(got, "doc_id", "n_features", "weight", "score", "rank") == plain_resample([r[:2] for r in rows], target)
    assert {r["doc_id"] for r in resampling.drawn(docs, got).collect()} == {r["doc_id"] for r in got.collect() if r["rank"] and r["doc_id"] is not None}


def test_odd_and_empty_tables(spark):
    odd, none = spark.createDataFrame(ODD, DOC), spark.createDataFrame([], DOC)
    assert quality_rules.judge(odd).count() == len(ODD) and quality_rules.judge(none).count() == 0
    assert all(r["base_failed"] and not r["kept"] for r in quality_rules.judge(odd).collect())  # short, or repeating itself
    assert resampling.resample(odd, none).count() == len(ODD) and resampling.resample(none, odd).count() == 0
