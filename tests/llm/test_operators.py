"""Edge cases, defined results and brute-force comparisons of the training-data operators."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm import ann, components, decontam, language_id, license_scan, ngram_join, queries, sentencepiece_codec, sharding, suffix_dedup, url_filter, warc

DOCS = "doc_id bigint, text string, lang string, source string, id bigint, row string, word string, spans string"


def documents(spark, rows):
    """Rows (doc_id, text, lang) among columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s", 7, "r", "w", "x") for i, t, g in rows], DOCS)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# Language ID


def train(spark):
    rng = random.Random(1)
    en, de = ["the", "and", "of", "thing", "with", "other"], ["der", "und", "nicht", "schön", "wäre", "zeit"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(40)), "en" if i % 2 else "de") for i in range(60)]
    return documents(spark, rows + [(100, None, "en"), (101, "xx", None), (102, "12", "none")])


def test_language_mixtures(spark):
    model = language_id.fit(train(spark), sample_docs=20)
    assert model.languages == ("de", "en")
    mixed = "the and of with other thing the and of with " + "der und nicht schön zeit wäre der und nicht zeit"
    docs = documents(spark, [(1, "THE other thing", None), (2, "und der zeit", None), (3, None, None), (4, "", None), (5, "12 .!", None), (6, mixed, None), (1, "THE other thing", None), (None, "und", "en"), (8, "the " * 30000, None), (9, "qxqz jjkk zzxq vvww", None)])
    rows = language_id.identify(docs, model).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert len(rows) == 10 and len(got[1]) == 2 and got[1][0] == got[1][1]
    assert [got[i][0]["lang_pred"] for i in (1, 2, 3, 4, 5, None, 8)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert [got[i][0]["score"] for i in (3, 4, 5)] == [0, 0, 0]
    assert sorted(got[6][0]["languages"]) == ["de", "en"] and all(0.3 < s < 0.7 for s in got[6][0]["shares"])
    assert got[1][0]["languages"] == ["en"] and got[9][0]["noise"] > 0.5
    carried = language_id.identify(docs, model, carry=True)
    assert carried.select("row.*").columns == docs.columns and carried.count() == 10


def test_language_letters_are_unicode(spark):
    model = language_id.fit(train(spark))
    none = ["12 \u2014 34", "\u2026", "\u3002", "\u0661\u0662\u0663", "\u20ac 5", "\U0001f600", "\u00a0", "\u0301", None, ""]
    docs = documents(spark, [(i, t, None) for i, t in enumerate(none)] + [(100, "SCH\u00d6N W\u00c4RE", None), (101, "sch\u00f6n w\u00e4re", None), (102, "the\u2014thing, other\u2026the" * 60_000, None)])
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in range(len(none)))
    assert got[100]["lang_pred"] == "de" and got[100]["shares"] == got[101]["shares"] and got[102]["lang_pred"] == "en"


def plain_mixture(model, text):
    """One document at a time, word by word: proportions after 10 rounds, then languages dropped while BIC allows."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    k = len(model.languages)
    rows = []
    for word in words:
        data = [0, 0, *map(ord, word)]
        score = [0.0] * k + [model.noise * (len(data) - 2)]
        for i in range(2, len(data)):
            bucket = (((data[i] | data[i - 1] << 21 | data[i - 2] << 42) * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 48
            for j in range(k):
                score[j] += float(model.log_prob[bucket, j])
        top = max(score)
        rows.append([math.exp(max(x - top, -60)) for x in score])

    def em(share, rounds):
        for _ in range(rounds):
            sums = [0.0] * (k + 1)
            for r in rows:
                joint = [a * b for a, b in zip(r, share, strict=True)]
                for j in range(k + 1):
                    sums[j] += joint[j] / sum(joint)
            share = [x / len(rows) for x in sums]
        return share, sum(math.log(sum(a * b for a, b in zip(r, share, strict=True))) for r in rows)

    share, now = em([1 / (k + 1)] * (k + 1), 10)
    while len(alive := [j for j in range(k) if share[j] > 0]) > 1:
        weakest = min(alive, key=lambda j: share[j])
        trial = [0.0 if j == weakest else x for j, x in enumerate(share)]
        tried, then = em([x / sum(trial) for x in trial], 3)
        if then + 0.5 * math.log(len(rows) + 1) < now:
            break
        share, now = tried, then
    return share


def test_language_mixtures_equal_plain_em(spark):
    model = language_id.fit(train(spark))
    rng = random.Random(12)
    vocabulary = ["the", "and", "thing", "der", "nicht", "sch\u00f6n", "w\u00e4re", "zeit", "qxq", "zzk"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    for r in language_id.identify(documents(spark, [(i, t, None) for i, t in enumerate(texts)]), model).collect():
        share = plain_mixture(model, texts[r["doc_id"]])
        found = dict(zip(r["languages"], r["shares"], strict=True))
        assert all(abs(found.get(g, 0) - share[j]) < 1e-6 for j, g in enumerate(model.languages)) and abs(r["noise"] - share[-1]) < 1e-6


def test_language_empty(spark):
    none = documents(spark, [])
    model = language_id.fit(none)
    assert model.languages == ()
    assert language_id.identify(none, model).count() == 0
    assert language_id.identify(documents(spark, [(1, "a word", None)]), model).first()["lang_pred"] == "und"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert found.where("score < 0 OR score > 1").count() == 0


# URL filter


def judged(spark, urls, rules=queries.URL_RULES):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, path string")
    table = url_filter.rule_table(spark, rules)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, table).collect()}


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/8?x", "http://example.com/en/7x#f", "https://com/en/", "http://net/de/1", "ftp://m.example.net/de/80", "http://badcom/en/1", None, "no-url", "http://", "http://x.org/es/", "http://x.org:80/es/", "http://com?/en/", "a://b.com/en/://c.net/de/", "http://\u00c4.com/en/"]
    got = judged(spark, urls)
    assert got[0] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[1] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("com", "/en/", "com/en/", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block")
    assert got[5][2:] == (None, "allow") and got[6] == got[7] == ("", "", None, "allow") == got[8]
    assert got[9][3] == "block" and got[10][3] == "allow" and got[11] == ("com", "", None, "allow")
    assert got[12] == ("b.com", "/en/://c.net/de/", "com/en/", "block") and got[13][0] == "\u00c4.com"
    assert len(judged(spark, ["http://x.com/en/" + "a" * 50000] * 5)) == 5
    assert judged(spark, []) == {} and judged(spark, ["http://a.com/"], [])[0][3] == "allow"


def test_url_rules_against_brute_force(spark):
    rng = random.Random(3)
    hosts, paths = ["a", "b.a", "c.b.a", "a.b"], ["", "/", "/x", "/xy", "/x/y"]
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h in hosts for p in paths if rng.random() < 0.4}.values())
    urls = [f"http://{rng.choice(['', 'z.', 'c.', 'y.b.'])}{rng.choice(hosts)}{rng.choice(paths + ['/x/yz', '/q'])}" for _ in range(80)]
    for i, (host, path, rule, verdict) in judged(spark, urls, rules).items():
        fits = [(len(h + p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (rule, verdict) == (max(fits)[3:] if fits else (None, "allow")), urls[i]


# WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id bigint, url string, html string, shard int, digest string")


def test_warc_round_trip(spark, tmp_path):
    big, long = "é" * 600, "x" * 300_000
    rows = [(1, "http://a/", big), (3, "http://b/\r\nX: 1", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", long), (7, "u", ""), (3, "http://b/", big), (None, "n", big)]
    got = warc.archive(pages(spark, rows), f"file://{tmp_path}/a", shard_bytes=2000, roll_bytes=1000).collect()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == sorted([("1", "revisit", 3, 1200), ("3", "response", None, 1200), ("3", "response", None, 1200), ("2", "response", None, 5), ("4", "response", None, 5), ("5", "response", None, 0), ("6", "response", None, 300000), ("7", "response", None, 0), ("None", "response", None, 1200)])
    by = {r["page_id"]: r for r in got}
    assert by[6]["payload"] == long.encode() and by[1]["payload"] is None
    assert all(by[i]["payload_digest"] == hashlib.sha1((t or "").encode()).hexdigest() for i, _, t in rows)
    names = [r["name"] for r in warc.manifest(spark, f"file://{tmp_path}/a").collect()]
    assert len(names) > 1 and sorted(p.name for p in (tmp_path / "a").glob("part-*")) == sorted(names)


def test_warc_same_bytes_for_any_partitioning(spark, tmp_path):
    rows = [(i * 7 % 101, f"http://h/{i}", f"{i} " * (i * 5)) for i in range(101)]
    sums = []
    for k, n in enumerate((1, 7)):
        root = f"file://{tmp_path}/{k}"
        warc.write_warc(warc.records(pages(spark, rows).repartition(n)), root, shard_bytes=20_000, roll_bytes=1_000)
        sums.append(sorted((r["name"], r["sha256"]) for r in warc.manifest(spark, root).collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 5
    assert not list((tmp_path / "0" / "_temporary").glob("*"))


def test_warc_empty(spark, tmp_path):
    assert warc.archive(pages(spark, []), f"file://{tmp_path}/e").count() == 0


# Sharding


def test_shards_fit_and_only_oversized_buckets_split(spark):
    rng = random.Random(5)
    rows = [(i, "a" * rng.randrange(200), None) for i in range(400)] + [(None, "b" * 90, None)] * 40 + [(7, f"{i}" * 30, None) for i in range(60)] + [(401, "c" * 5000, None), (402, None, None), (403, "", None)]
    got = sharding.assign_shards(documents(spark, rows), limit=1000).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert sum(r["n_bytes"] for r in got) == sum(len((t or "").encode()) for _, t, _ in rows)
    total, count = defaultdict(int), defaultdict(int)
    for r in got:
        total[r["shard"]] += r["n_bytes"]
        count[r["shard"]] += 1
    assert all(total[s] <= 1000 or count[s] == 1 for s in total)
    plain = {s: b for s, b in total.items() if "/" not in s}
    for shard in plain:
        if len(shard) and len(shard) <= 32:
            parent = sum(b for s, b in total.items() if s.startswith(shard[:-1]))
            assert parent > 1000
    assert not any(a != b and b.startswith(a) for a in plain for b in plain)


def test_shards_of_little(spark):
    assert sharding.assign_shards(documents(spark, [])).count() == 0
    got = sharding.assign_shards(documents(spark, [(1, "ab", None), (1, "ab", None), (None, None, None)])).collect()
    assert {(r["shard"], r["depth"]) for r in got} == {("", 0)} and len(got) == 3


# Licenses


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    mit = license_scan.TEMPLATES[3][1]
    rng = random.Random(2)
    rows = [(1, f"{sentence(rng, 50)} {apache.upper()} {sentence(rng, 33)}", None), (2, mit.replace("charge", "cost"), None), (3, None, None), (4, "", None), (5, " .", None), (6, "Licensed under", None), (1, "released under the mit license", None), (None, "licensed  under\nCC-BY NC 4.0", None), (9, sentence(rng, 30000) + " " + apache, None), (10, " ".join(mit.split()[::2]), None)]
    got = defaultdict(list)
    for r in license_scan.scan(documents(spark, rows), license_scan.template_table(spark)).collect():
        got[r["doc_id"]].append(r["licenses"])
    assert sorted(got[1]) == [["Apache-2.0"], ["MIT"]]
    assert [got[i] for i in (3, 4, 5, 6, None, 9, 10)] == [[[]], [[]], [[]], [[]], [["CC-BY-NC-4.0"]], [["Apache-2.0"]], [[]]]
    assert got[2] == [["MIT"]]
    assert license_scan.scan(documents(spark, []), license_scan.template_table(spark)).count() == 0
    assert license_scan.scan(documents(spark, rows[:2]), license_scan.template_table(spark).where("false")).where("size(licenses) > 0").count() == 0


def test_license_bands():
    bands = license_scan.bands_needed(80, 0.9999)
    assert 1 - (1 - 0.8 / 4.2) ** bands >= 0.9999 > 1 - (1 - 0.8 / 4.2) ** (bands - 1)


# Nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id bigint, embedding array<float>, id bigint, code string")


def brute(rows, k):
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % 5 == 0:
            out[i] = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows if j != i)[:k]
    return out


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    rows = [(i, (base[i % 150] + (0.01 if i % 3 else 0)).tolist()) for i in range(300)]
    got = defaultdict(list)
    for r in ann.nearest_neighbours(vectors(spark, rows).repartition(3), F.col("id") % 5 == 0, k=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    expected = brute(rows, 7)
    assert got.keys() == expected.keys()
    hits = sum(len({j for _, j in got[q]} & {j for _, j in expected[q]}) for q in expected)
    assert hits / (7 * len(expected)) > 0.99
    assert all(abs(a - b) < 1e-9 for q in expected for (a, _), (b, _) in zip(got[q], expected[q], strict=True))


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (12, [None, 1.0]), (15, [1.0]), (None, [1.0, 1.0])]
    got = ann.nearest_neighbours(vectors(spark, rows), F.col("id") % 5 == 0, k=10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 3, 0.0), (0, 2, 3, 0.0), (0, 3, 5, 0.0), (5, 1, 0, 0.0), (5, 2, 3, 0.0), (5, 3, 3, 0.0)]
    more = [(20, [2.0]), (21, [4.0]), (25, [1.0, 2.0]), (25, [1.0, 3.0]), (25, [1.0, 3.0])]
    got = ann.nearest_neighbours(vectors(spark, rows + more), F.col("id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 3, 0.0), (0, 3, 0.0), (20, 15, 1.0), (20, 21, 2.0)]
    assert ann.nearest_neighbours(vectors(spark, rows + more), F.col("id") == 25, k=9).groupBy("query_id").count().first()[1] == 8
    assert ann.nearest_neighbours(vectors(spark, []), F.col("id") % 5 == 0).count() == 0
    assert ann.nearest_neighbours(vectors(spark, [(0, [1.0])]), F.col("id") % 5 == 0).count() == 0


def test_query_blocks_change_nothing(spark):
    rng = np.random.default_rng(6)
    index = ann.build_index(ann.usable(vectors(spark, [(i, rng.standard_normal(8).tolist()) for i in range(120)]), "vec_id", "embedding"))
    asked = index.rows.select("id", "vector")
    one, many = (sorted(map(tuple, ann.search(index, asked, 3, block=b).collect())) for b in (4096, 25))
    assert one == many


# N-gram Jaccard join


def word_sets(rows, k):
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    return sets


def brute_components(rows, k, percent):
    sets = word_sets([r for r in rows if r[0] is not None], k)
    ids = sorted(sets)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = sorted((root[i], root[j]))
                root = {n: x if r == y else r for n, r in root.items()}
    return root


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 90, False), (5, 80, True), (1, 50, True)])
def test_join_matches_brute_force(spark, monkeypatch, k, percent, small):
    if small:  # hot families of a few nodes, compared in many blocks
        for name, value in (("BLOCK", 4), ("SKETCH_BLOCK", 4), ("PAIRED", 2)):
            monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(k)
    rows = []
    for base in range(12):
        words = sentence(rng, rng.choice([2, 3, 6, 12, 40, 120]), 60 if base < 6 else 5000).split()
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 8)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(40)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (None, rows[0][1]), (905, "É a"), (906, "é a"), (3, rows[3][1]), (3, "something else than that here")]
    got = ngram_join.join_components(documents(spark, [(i, t, None) for i, t in rows]).repartition(4), shingle=k, percent=percent).collect()
    expected, sets = brute_components(rows, k, percent), word_sets(rows, k)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (expected[r["doc_id"]] if r["doc_id"] is not None else None), r
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_join_empty(spark):
    assert ngram_join.join_components(documents(spark, [])).count() == 0


def test_hamming_distance_of_parts_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for percent in (50, 80, 90):
        for n in (1, 4, 9, 30, 300):
            a = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = a.copy()
            apart = 0
            while len(np.intersect1d(a, b)) * 100 >= percent * len(np.union1d(a, b)):
                keys = [{int(x) for _, key in ngram_join.part_keys(s, np.array([0, len(s)]), percent) for x in key} for s in (a, np.sort(b))]
                assert keys[0] & keys[1], (percent, n, apart)
                b[apart] = rng.integers(0, 1 << 63)
                apart += 1


def test_components_of_a_chain_and_a_hot_node(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


# Suffix dedup


def brute_repeats(rows, length):
    """rows: (id, text) in order; {place: drop mask}."""
    seen, out = set(), {}
    for place, (_, text) in rows:
        data = (text or "").encode()
        drop = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                drop[p : p + length] = True
            seen.add(window)
        out[place] = drop
    return out


@pytest.mark.parametrize("length", [7, 20, 100])
def test_repeats_match_brute_force(spark, length):
    rng = random.Random(length)
    passages = [sentence(rng, 40, 5000) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(1, 40), 5000 if i % 3 else 4)] + [rng.choice(passages)[rng.randrange(30) : rng.randrange(60, 250)] for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        rows.append((i * 3, " é".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 1000), (503, "ab" * 300), (504, rows[3][1]), (505, rows[3][1] + "x"), (-5, passages[0]), (506, "x" * (length - 1)), (507, "q" * length), (508, "q" * length)]
    rng.shuffle(rows)
    got = suffix_dedup.remove_repeats(documents(spark, [(i, t, None) for i, t in rows]).repartition(5), length=length).collect()
    expected = brute_repeats([(i, (i, t)) for i, t in sorted(rows, key=lambda r: r[0])], length)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        data, drop = (texts[r["doc_id"]] or "").encode(), expected[r["doc_id"]]
        assert r["n_bytes"] == len(data)
        assert bytes(r["kept"]) == bytes(np.frombuffer(data, np.uint8)[~drop]), r["doc_id"]
        assert r["kept_text"] == bytes(r["kept"]).decode("utf-8", "ignore")
        assert len(r["spans"]) == int((np.diff(np.concatenate([[0], drop.astype(int)])) == 1).sum())


def test_repeats_of_repeated_ids(spark):
    rng = random.Random(8)
    far = 2**62 + 5
    a, b, c, long = (sentence(rng, n, 50000) for n in (60, 60, 60, 180_000))
    rows = [(1, a), (1, a), (1, b), (2, b + "!"), (far, c), (far, c + a), (far, c), (far + 1, "x" + c), (9, long), (10, long[700_000:] + "end"), (None, a), (None, a), (3, None), (3, None), (3, "")]
    assert len(long) > 1_000_000
    got = suffix_dedup.remove_repeats(documents(spark, [(i, t, None) for i, t in rows]).repartition(3), length=20).collect()
    order = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    drops = brute_repeats([(r, r) for r in order], 20)
    kept = [(i, bytes(np.frombuffer((t or "").encode(), np.uint8)[~drops[i, t or ""]]) if i is not None else t.encode()) for i, t in rows]
    assert sorted(((r["doc_id"], bytes(r["kept"])) for r in got), key=repr) == sorted(kept, key=repr)
    assert [k for i, k in kept if i == 1].count(a.encode()) == 2 and max(len(k) for _, k in kept) > 1_000_000
    words = spark.createDataFrame([("a", a), ("b", a + " b"), ("a", a)], "doc_id string, text string")
    assert sorted(len(r["kept"]) for r in suffix_dedup.remove_repeats(words, length=20).collect()) == [2, len(a), len(a)]
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


# Decontamination


def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        size = min(n, len(iw))
        for s in range(len(iw) - size + 1) if size else ():
            for p in range(len(w) - size + 1):
                if w[p : p + size] == iw[s : s + size]:
                    hit |= set(range(p, p + size))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, n, 30)) for i, n in enumerate([30, 12, 10, 9, 5, 4, 2, 1])] + [(10, None), (11, ""), (12, "é-É w1"), (2, sentence(rng, 11, 30)), (None, "only words without an id in this item here now ok")]
    docs = [(i, " ".join([sentence(rng, 20, 30), rng.choice(items)[1] or "", sentence(rng, 6, 30)]).replace(" ", rng.choice([" ", ", ", "\n"]))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "."), (103, items[0][1].upper()), (103, items[0][1].upper()), (None, items[1][1]), (104, items[-1][1]), (105, (items[0][1] + " ") * 200), (106, "É é w1")]
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, token int")
    got = decontam.contamination(documents(spark, [(i, t, None) for i, t in docs]), table)
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in got.collect())
    expected = []
    for i, t in docs:
        n, hit, names = brute_hits(t, items)
        expected.append((str(i), n, hit, names, hit > 0))
    assert found == sorted(expected)


def test_decontamination_empty(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontam.contamination(documents(spark, []), items).count() == 0
    got = decontam.contamination(documents(spark, [(1, "a b", None)]), items.where("false")).first()
    assert (got["n_words"], got["n_hit"], got["item_ids"], got["contaminated"]) == (2, 0, [], False)


# SentencePiece


def test_codec_equals_the_library(spark):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    rng = random.Random(9)
    texts = [None, "", " ", "   ", "a", " a ", "a  b\n\nc\t d ", "x\u2581y \u2581\u2581z", "<s> </s> <unk> <0x41>", "é 🙂 ｆ \ufeff\x00", "z" * 30000, "ab " * 20000, "日本語のテキスト。空白なし"]
    texts += ["".join(rng.choice(" \n\t\u2581abcé🙂1.,'<>") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "x", None), (4, "a", None)]
    got = sentencepiece_codec.encode_texts(documents(spark, rows), queries.piece_model()).collect()
    assert len(got) == len(rows)
    for r in got:
        t = (texts[r["doc_id"]] or "") if r["doc_id"] is not None else "x"
        assert r["ids"] == whole.encode(t) and r["decoded"] == whole.decode(whole.encode(t)), repr(t)
    assert sentencepiece_codec.encode_texts(documents(spark, []), queries.piece_model()).count() == 0


def test_codec_table_starts_anew(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_codec, "TABLE_CHARS", 10)
    whole = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    table = sentencepiece_codec.ChunkTable(whole)
    for t in ("one two three", "two four", "one five"):
        ids, sizes, decoded = table.encode([t])
        assert ids.tolist() == whole.encode(t) and decoded == [t] and sizes.tolist() == [len(ids)]
