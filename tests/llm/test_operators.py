"""Operators on Spark: brute force, and nulls, empty and long texts, ties, repeats, clashing names."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import components, decontaminate, html_wrapper, langid, mixing, mtree, near_dup, sharding, toxicity, url_reputation, warc
from marlstone.session import cut
from tests.llm.test_words_and_models import plain_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [words(rng, rng.randint(5, 120)) for _ in range(60)]
    out = list(texts)
    for t in texts[:20]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [texts[3]] * 40 + ["", None, "!!!", "one", "One!", "one two three", words(rng, 30000)]
    data = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(out)]
    return data + [data[5], data[5], (None, texts[8], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cut(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(text):
    w = plain_words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def test_near_duplicates_equal_brute_force(docs, rows):
    bags = {t: bag(t) for _, t, *_ in rows}
    texts = [t for t in bags if bags[t] is not None]
    up = {t: t for t in texts}

    def find(t):
        while up[t] != t:
            t = up[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        both = sum((bags[a] & bags[b]).values())
        if 5 * both >= 4 * sum((bags[a] | bags[b]).values()):
            up[find(a)] = find(b)
    members = defaultdict(list)
    for k, t, *_ in rows:
        if t in up:
            members[find(t)].append(k)
    want = Counter((k, min(x for x in m if x is not None), len(m)) for m in members.values() for k in m)
    want += Counter((k, k, 1) for k, t, *_ in rows if t not in up)
    got = near_dup.classes(docs).select("k", "class_id", "class_size").collect()
    assert Counter(map(tuple, got)) == want
    kept = near_dup.kept(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([min(x for x in m if x is not None) for m in members.values()] + [k for k, t, *_ in rows if t not in up])


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(9)
    base = words(rng, 200).split()
    data = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(200)] = f"x{rng.randint(0, 10**6)}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, words(rng, 100) + " " + " ".join(base[:40])) for i in range(100)]  # share a passage only
    got = near_dup.classes(spark.createDataFrame(data, "doc_id long, text string"), pivots=4).collect()
    size = Counter(r.class_id for r in got)
    assert size[0] == 400 and len(size) == 101


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 640)] + [(None, 1), (5, None), (7, 7)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in list(up)} and len(got) == len(up)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(text, items, window=13):
    wins = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins[tuple(w[k : k + n])].add("" if i is None else str(i))
    w, found = plain_words(text), set()
    hit = [False] * len(w)
    for n in {len(k) for k in wins}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                found |= wins[tuple(w[k : k + n])]
                hit[k : k + n] = [True] * n
    x = sum(hit)
    return len(w), x, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), x > 0 and 20 * x >= len(w)


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(11)
    items = [(i, words(rng, rng.choice([1, 2, 3, 12, 13, 14, 40]))) for i in range(25)] + [(90, ""), (91, None), (92, "!"), (None, words(rng, 20))]
    items += [(100, items[7][1]), (100, items[7][1])]
    data = [(0, None), (1, ""), (2, "?!"), (3, words(rng, 20000))]
    for i in range(4, 80):
        t = words(rng, rng.randint(1, 80)).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t)) : 0] = (rng.choice(items)[1] or "").upper().split()
        data.append((i, ", ".join(t)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = docs.select("doc_id", decontaminate.judged(docs, bench, block_bytes=block_bytes).alias("r")).select("doc_id", "r.*").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: brute_hits(t, items) for i, t in data}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {i for i, t in data if not brute_hits(t, items)[4]}
    clean = decontaminate.decontaminate(docs, bench, quotes=False, block_bytes=block_bytes)
    assert {r[0] for r in clean.collect()} == {i for i, t in data if not brute_hits(t, items)[1]}


def test_decontamination_without_items(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    got = docs.select(decontaminate.judged(docs, none).alias("r")).select("r.*").collect()
    assert all(r.n_hit == 0 and not r.contaminated and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert decontaminate.decontaminate(empty, none).count() == 0


def brute_targets(sizes):
    """Water filling by repeated rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        t = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if t[s] > 2 * sizes[s] + 1e-9]
        if not above:
            return fixed | t
        fixed |= {s: 2.0 * sizes[s] for s in above}


def test_mixing(docs, rows):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(r["__size"] == size(r.text) for r in got)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r["__size"]
        largest[r.source] = max(largest[r.source], r["__size"])
        taken[r.source] += r["__size"] * r["__times"]
        assert 0 <= r["__times"] <= 2
    want = brute_targets(sizes)
    for r in got:
        assert r["__source_size"] == sizes[r.source] and abs(r["__target"] - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:  # one source is mostly one document
        assert abs(taken[s] - want[s]) <= (largest[s] / 2 if largest[s] > 1000 else 3), (s, taken[s], want[s])
    again = mixing.mixed(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r["__times"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_nothing(empty, spark):
    assert mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, None, None, None)], DOCS)
    assert [(r["__size"], r["__times"]) for r in mixing.mixed(blank).collect()] == [(0, 0), (0, 0)]


def test_sharding(docs, rows, empty):
    got = sharding.sharded(docs).collect()
    n = len(rows)
    assert sorted(r["__position"] for r in got) == list(range(n))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = sharding.permute(sharding.np.arange(n), n, sharding.SEED)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["__position"]) for r in got) == sorted((x[0] if x[0] is not None else -1, int(p)) for x, p in zip(order, at, strict=True))
    for r in got:
        raw = (r.text or "").encode()
        assert (r["__size"], r["__crc"]) == (len(raw) + 1, zlib.crc32(raw))
        assert (r["__shard"], r["__slot"]) == (r["__position"] % 8, r["__position"] // 8)
    count = Counter(r["__shard"] for r in got)
    assert max(count.values()) - min(count.values()) <= 1
    again = sharding.sharded(docs.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r["__position"]) for r in got if r.doc_id != 5) == sorted((r.doc_id or -1, r["__position"]) for r in again if r.doc_id != 5)
    assert sharding.sharded(empty).count() == 0


def test_many_ranges_of_row_numbers(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100003 - 50000).alias("doc_id"))
    got = sharding.numbered(df, "doc_id", []).collect()
    assert [r["__row"] for r in sorted(got, key=lambda r: r.doc_id)] == list(range(5000))
    # one key on many rows is cut by its ties, and a key may be text
    hot = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("doc_id"), (F.col("id") * 31 % 3001).alias("tie"))
    got = sharding.numbered(hot, "doc_id", [F.col("tie")], range_rows=100).collect()
    assert [r["__row"] for r in sorted(got, key=lambda r: (r.doc_id, r.tie))] == list(range(3000))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Www.Example.COM/en/7x", "http://example.com/en/1", "http://a.example.com/EN/1", "https://x.example.net/de/8", "http://x.example.net/de/9?q", "http://org/es/", "ftp://b.org/es", "http://xexample.com/en/7", "a://b?c/d", "http://h#f", "x://y/z://w/q"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(4, urls[4], "y")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(4, 1, 0), (5, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_reputation.judged(pages, labels).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (i, host, path, rule, rules[rule] if rule else "allow") in got
    assert len(got) == len(urls)


def test_bad_hosts_are_shrunk_and_blocked(spark):
    pages, labels = [], []
    for host, n, bad in (("spam.bad.com", 200, 180), ("a.good.com", 300, 20), ("b.good.com", 2, 2), ("c.other.net", 400, 40), ("new.bad.com", 1, 0)):
        for i in range(n):
            pages.append((len(pages), f"http://{host}/{i}"))
            labels.append((len(labels), int(i >= bad), 0))
    labels.pop()  # new.bad.com has no label
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rep = {r.host: r for r in url_reputation.reputation(p, lab).collect()}
    assert rep["spam.bad.com"].blocked and not rep["a.good.com"].blocked and not rep["c.other.net"].blocked
    assert 0.06 < rep["b.good.com"].mean < 0.9  # two bad pages don't condemn a host of a good domain
    assert rep["new.bad.com"].mean > rep["c.other.net"].mean  # it takes after its domain
    assert url_reputation.judged(p.limit(0), lab).count() == 0


def test_subdomains_of_a_registered_domain_are_pooled(spark):
    want = {"www.spam.com": "spam.com", "spam.com": "spam.com", "a.b.spam.co.uk": "spam.co.uk", "co.uk": "co.uk", "com": "com", "": "", "10.0.0.1": "10.0.0.1", "10.0.0.1:80": "10.0.0.1",
            "u@www.spam.com:8080": "spam.com", "www.spam.com.": "spam.com", "x.y.example.com": "y.example.com", "me.github.io": "me.github.io"}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: r.domain for r in hosts.select("host", url_reputation.registered(F.col("host"))[1].alias("domain")).collect()} == want
    pages, labels = [], []
    for host, n, bad in (("www.spam.com", 100, 95), ("shop.spam.com", 100, 92), ("new.spam.com", 1, 0), ("fine.com", 300, 10), ("a.fine.co.uk", 100, 5), ("b.bad.co.uk", 100, 90), ("c.bad.co.uk", 1, 0)):
        for i in range(n):
            pages.append((len(pages), f"http://{host}/{i}"))
            if n > 1:
                labels.append((pages[-1][0], int(i >= bad), 0))
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rep = {r.host: r for r in url_reputation.reputation(p, lab).collect()}
    assert rep["new.spam.com"].blocked and rep["c.bad.co.uk"].mean > 0.5  # unlabelled hosts of bad domains
    assert not rep["fine.com"].blocked and not rep["a.fine.co.uk"].blocked


def test_warc_round_trip(spark, tmp_path):
    html = ["a", "a", None, "", "é\r\n\r\nWARC/1.1\r\nx", "long " * 600_000, "a"]
    data = [(i, f"http://h/{i} x\n", h, b"1") for i, h in enumerate(html)] + [(3, "u", "", b"2"), (None, None, "only null", b"3")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, chunk binary")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    raw = {r: (r[2] or "").encode() for r in data}
    last = {}
    for r in data:
        last[raw[r]] = max(last.get(raw[r], -1), -1 if r[0] is None else r[0])
    want = set()
    for r in data:
        first = last[raw[r]] if last[raw[r]] >= 0 else None
        mine = r[0] == first
        want.add((r[0], len(raw[r]), base64.b32encode(hashlib.sha1(raw[r]).digest()).decode(), "response" if mine else "revisit", None if mine else first))
    assert got == want
    folder = f"file://{tmp_path}/w"
    made = warc.write(pages, folder)
    assert made.agg(F.sum("records")).first()[0] == len(data)
    parts = warc.chunks(made, folder, chunk=100_000).where("bytes_so_far > 0 or last").collect()
    big = sorted((r for r in parts if r.record_id == "5"), key=lambda r: r.chunk_no)
    assert len(big) == 30 and b"".join(r.chunk for r in big) == html[5].encode()
    sha = hashlib.sha1()
    for r in big:
        sha.update(r.chunk)
        assert r.digest_so_far == base64.b32encode(sha.digest()).decode()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_digests_come_from_the_chunk_table(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(warc, "cut", lambda df, name: tables.append(cut(df, name)) or tables[-1])
    html = ["a", "", "é", "long " * 600_000]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")).collect()}
    made = next(t for t in tables if "chunk" in t.columns)
    pieces = defaultdict(dict)
    for r in made.collect():
        pieces[r.archive, r.record_no][r.chunk_no] = bytes(r.chunk)
    assert sorted(b"".join(p[k] for k in sorted(p)) for p in pieces.values()) == sorted(h.encode() for h in html) and max(map(len, pieces.values())) > 2
    for i, h in enumerate(html):
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
    other = made.withColumn("chunk", F.when(F.col("bytes_so_far") == 1, F.lit(b"xyz")).otherwise(F.col("chunk")))
    assert {r.bytes_so_far for r in warc.digested(other).collect()} == {3, 0, 2, 3_000_000}
    with pytest.raises(Exception, match="lacks chunk"):
        warc.digested(made.where("chunk_no <> 1")).collect()
    with pytest.raises(Exception, match="lacks chunk"):
        warc.digested(made.where("chunk_no = 0 or not last")).collect()


def test_top_k(spark):
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    data = [(i, vec()) for i in range(300)] + [(900 + i, data_) for i, data_ in enumerate([[0.5] * 6] * 60)]
    data += [(50, None), (100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (150, [float("nan")] * 6), (1000, [float("inf")] * 6), (1050, [0.1, 0.2]), (1100, [0.3, 0.4]), (None, vec()), (0, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    import numpy as np

    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in usable if j != i and len(x) == len(q))[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    got = mtree.top(df, F.col("vec_id") % 50 == 0, 5, shard_rows=100, page=16).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert mtree.top(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_toxicity_on_tables(docs, empty, spark):
    lab = spark.createDataFrame([(i, 1, int(i < 20)) for i in range(60)] + [(None, 1, 1), (70, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    got = docs.select("doc_id", toxicity.scored(docs, model).alias("r")).select("doc_id", "r.*").collect()
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in got)
    none = toxicity.train(empty, lab)
    assert not any(r[0] for r in docs.select(toxicity.scored(docs, none)["toxic"]).collect())
    assert empty.select(toxicity.scored(empty, none).alias("r")).count() == 0


def test_toxicity_passes_over_texts_that_do_not_fit(spark):
    rng = random.Random(9)
    data = [(i, " ".join(rng.choice(("vile", "nasty") if i % 3 == 0 else ("kind", "calm")) for _ in range(20)) + f" w{i}") for i in range(90)]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    large = [(i, "kind " * 8000) for i in range(90, 200)]
    docs = spark.createDataFrame(data + large, "doc_id long, text string")
    model = toxicity.train(docs, lab, sample_bytes=30_000)  # less than any of the large ones
    got = {r.doc_id: r.toxic for r in docs.select("doc_id", toxicity.scored(docs, model)["toxic"].alias("toxic")).collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(90))
    with pytest.raises(ValueError, match="fits"):
        toxicity.train(spark.createDataFrame(data[:1] + large, "doc_id long, text string").where("doc_id % 3 <> 0 or doc_id > 89"), lab, sample_bytes=30_000)
    assert toxicity.fitting([(True, 9), (False, 50), (False, 20), (True, 2), (False, 9)], {"toxic": 1, "clean": 3}, 40) == [True, False, True, False, True]
    assert all(toxicity.fitting([(True, 30), (False, 10)], {"toxic": 1, "clean": 3}, 40))


def test_language_on_tables(docs, empty):
    net = langid.train(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")))
    got = docs.select("text", langid.predicted(docs, net).alias("p")).select("text", "p.*").collect()
    assert all((r.lang == "und" and r.score == 0) == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert {r.lang for r in got} <= {"en", "fr", "und"}
    nothing = langid.train(empty)
    assert {r[0] for r in docs.select(langid.predicted(docs, nothing)["lang"]).collect()} == {"und"}


def test_language_training_takes_each_row_as_it_is(spark):
    """Repeated ids whose other rows lack a text or a language, and repeated rows."""
    text = {"en": "the cat sat on the mat and looked at it", "fr": "le chat était assis sur le tapis et voilà"}
    data = [(i, f"{text[x]} {i}", x) for i in range(40) for x in (("en", "fr")[i % 2],)]
    odd = [(i, None, "en") for i in range(10)] + [(i, f"{text['en']} other", None) for i in range(10)] + data[:5] * 3 + [(None, text["fr"], "fr")]
    seen = []
    real, langid.learn = langid.learn, lambda texts, **how: seen.append(sorted(texts)) or real([("a b", "en"), ("c d", "fr")], **how)
    try:
        langid.train(spark.createDataFrame(data + odd, "doc_id long, text string, lang string"))
    finally:
        langid.learn = real
    assert seen[0] == sorted([(t, x) for _, t, x in data] + [(text["fr"], "fr")])


def test_html_on_tables(spark):
    from tests.llm.test_words_and_models import page

    data = [(i, f"http://h{i % 2}.com/{i}", page(i, [f"par {i} {k}" for k in range(1 + i % 3)])) for i in range(40)]
    data += [(40, None, None), (41, "http://h0.com/x", ""), (42, "nohost", "<p>a</p>"), (0, *data[0][1:])]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_wrapper.extracted(pages).collect()
    want = Counter((i, f"http://h{i % 2}.com/{i}", "\n".join([f"T {i}", *(f"par {i} {k}" for k in range(1 + i % 3))])) for i in [*range(40), 0])
    want += Counter([(40, None, ""), (41, "http://h0.com/x", ""), (42, "nohost", "a")])
    assert Counter((r.page_id, r.url, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
    assert html_wrapper.extracted(pages.limit(0)).count() == 0


def test_html_slots_are_counted_over_all_pages(spark):
    html = "<body><div class=ad>{0}</div><section>Same everywhere</section><div><p>{1}</p></div><table><tr><td>{2}</td></tr></table></body>"
    link = "<a href=/>a list of links</a>"
    data = [(i, f"http://hot.com/{i}", html.format(i, "one body", link)) for i in range(120)]  # a group of near copies
    data += [(i, f"http://hot.com/{i}", html.format(i, f"other body {i}", "prose at last")) for i in range(120, 126)]
    data += [(130 + i, f"http://few.com/{i}", f"<body><h2>x</h2><p>{i // 3}</p></body>") for i in range(6)]  # two distinct pages
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrapper.extracted(pages).collect()}
    assert {got[i] for i in range(120)} == {"one body"}
    assert all(got[i] == f"other body {i}\nprose at last" for i in range(120, 126))
    assert [got[130 + i] for i in range(6)] == [f"x\n{i // 3}" for i in range(6)]


def test_pipeline_stages(spark, tmp_path, docs, rows):
    docs.select(*[c.split()[0] for c in DOCS.split(", ")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[10][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in out)
    assert 10 not in ids and max(ids.values()) <= 2
    assert sorted(r.slot * 8 + r.shard for r in out) == list(range(len(out)))
    # odd input: names that clash, nulls, repeats, texts that quote the benchmark in passing; empty tables
    odd = docs.withColumns({"shard": F.lit("x"), "slot": F.lit(9)}).unionByName(docs.where("doc_id < 40").withColumns({"shard": F.lit(None).cast("string"), "slot": F.lit(9)}))
    quote = docs.where("doc_id = 10").withColumns({"doc_id": F.lit(9999).cast("long"), "text": F.concat(F.lit("own word " * 2000), F.col("text"))})
    odd.unionByName(quote.withColumns({"shard": F.lit("q"), "slot": F.lit(9)})).write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for d in ("odd", "none"):
        for t in ("labels", "benchmark"):
            part = spark.read.parquet(f"{tmp_path}/{t}.parquet")
            (part if d == "odd" else part.limit(0)).write.parquet(f"{tmp_path}/{d}/{t}.parquet")
    again = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert again.columns == [*docs.columns, "shard", "slot"]
    got = again.collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in odd.collect()} - {10} and len(got) > 20
    assert sorted(r.slot * 8 + r.shard for r in got) == list(range(len(got)))
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontaminate", "mixing", "sharding"]
