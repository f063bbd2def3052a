"""Licences, quality rules, near-duplicates, passages and the pipeline against brute force."""

import collections
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mailbench.llm import paragraph_dedup, quality_rules
from mailbench.llm.common import connected_components, with_own_key
from mailbench.llm.license_scan import known_licenses, license_scan, license_scan_sql
from mailbench.llm.license_texts import LICENSES, long_texts
from mailbench.llm.paragraph_dedup import WordHashes, anchors, linked, repeated_passages, run_hashes, tune_bands, without_repeats
from mailbench.llm.quality_rules import quality_verdicts, word_statistics
from mailbench.llm.simhash import fingerprint, fingerprint_links, simhash_components
from mailbench.llm.token_counts import token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "one", "one two", "a b c a b c a b c", "É ß #$ |\n|\n|\n\n x", "same line\nsame line\nSame line\n same line", "tok " * 4000]


def frame(spark, texts, start=0):
    """Documents with nulls, a repeated row and columns that clash with the operators' own names."""
    rows = [(start + i, t, "en" if i % 2 else None, "s", len(t or ""), i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:1]], "doc_id long, text string, lang string, source string, n_chars long, start long, component string")


def words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(n)]


def sentences(seed, n):
    w = words(seed, n)
    return " ".join(" ".join(w[i:i + 8]) + "." for i in range(0, n, 8))


# Components


def brute_components(nodes, near):
    label = {a: a for a in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[a] > label[b] and near(a, b):
                    label[a], changed = label[b], True
    return label


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))] + [(i, i + 1) for i in range(200, 330)] + [(500, x) for x in range(600, 640)] + [(7, 7)]
    links = {frozenset(p) for p in pairs}
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()))
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    assert got == brute_components(nodes, lambda a, b: frozenset((a, b)) in links)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


# SimHash


def brute_fingerprint(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [*ODD, "A\x1cb\x85 C D", " ".join(words(1, 300)), " ".join(words(2, 70000))][:12]:
        assert fingerprint(text) == (brute_fingerprint(text) if len(text or "") < 30000 else fingerprint(text.upper()))


@pytest.mark.parametrize("n", [65538, 65539, 140000])
def test_fingerprints_of_long_texts(n):
    text = " ".join(words(n, n))
    assert fingerprint(text) == brute_fingerprint(text)
    # Two kinds of shingles in nearly equal number: one that is lost turns a bit.
    even = " ".join(["x"] * (n // 2 + 1) + ["y"] * (n - n // 2 - 1))
    assert fingerprint(even) == brute_fingerprint(even)


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5])
def test_links_connect_all_within_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(18):
            x = c
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= np.uint64(1) << np.uint64(bit)
            fps.add(int(x.view(np.int64)))
    fps |= {0, 1, -1, 7}
    links = connected_components(fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius), "test")
    got = {x: x for x in fps} | dict(map(tuple, links.collect()))
    assert got == brute_components(sorted(fps), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= radius)


def test_simhash_components(spark):
    base = " ".join(words(5, 400))
    texts = [*ODD, base, base + " tail", base.replace("a", "e"), base.upper(), "other " + base]
    got = {r.doc_id: r for r in simhash_components(frame(spark, texts, 3), "doc_id", "text").collect()}
    prints = {i + 3: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{p:016x}", want[k]) for k, p in prints.items()}
    assert simhash_components(frame(spark, texts), "doc_id", "text").count() == len(texts) + 1
    assert simhash_components(frame(spark, texts).limit(0), "doc_id", "text").count() == 0


# Quality rules


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {k for j in range(len(w) - 2) if seen[tuple(w[j:j + 3])] > 1 for k in (j, j + 1, j + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_word_statistics(spark, sf_dir):
    texts = [*ODD, *(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    got = word_statistics(frame(spark, texts), "doc_id", "text").drop("n_lines").distinct().collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: brute_statistics(t) for i, t in enumerate(texts)}


def brute_mcd(x, floors):
    """Best of many random starts, each concentrated to the end."""
    n, p = x.shape
    h, best = (n + p + 1) // 2, None
    extra = np.diag(np.square(floors))
    for seed in range(60):
        own = np.random.default_rng(seed).choice(n, p + 1, replace=False)
        for _ in range(60):
            m, c = x[own].mean(axis=0), np.cov(x[own].T, bias=True) + extra
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(own):
                break
            own = new
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m, c
    return best


def test_robust_estimates_reach_the_least_determinant(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((400, 5)) @ rng.standard_normal((5, 5)) + 3
    x = np.concatenate([good, rng.standard_normal((170, 5)) * 0.3 + 25])
    det, mean, cov = brute_mcd(x, quality_rules.FLOORS)
    rows = [("g", *map(float, r)) for r in x]
    vectors = spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    stats = quality_rules.stage(quality_rules.first_estimates(vectors), "t")
    for _ in range(quality_rules.ROUNDS):
        stats = quality_rules.stage(quality_rules.concentrate(vectors, stats), "t")
    assert min(r.logdet for r in stats.collect()) == pytest.approx(det, abs=0.1)  # whole bins: a few rows more than half
    out = quality_rules.with_distance(vectors.join(quality_rules.robust_estimates(vectors), "grp")).collect()
    distance = np.array([r.d2 for r in out])
    far = np.array([r.x0 > 15 and r.x1 > 15 for r in out])
    assert distance[far].min() > quality_rules.CUTOFF and (distance[~far] < quality_rules.CUTOFF).all()


def test_quality_verdicts(spark):
    clean = [sentences(i, 60 + i % 90) for i in range(300)]
    junk = [" ".join(w + "###$$$" for w in words(1000 + i, 120)) for i in range(30)]
    got = quality_verdicts(frame(spark, [*clean, *junk, *ODD])).collect()
    assert len(got) == len(clean) + len(junk) + len(ODD) + 1
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(len(clean)))
    assert not any(kept[len(clean) + i] for i in range(len(junk) + len(ODD)))
    few = quality_verdicts(frame(spark, clean[:20])).collect()
    assert all(r.kept and r.distance is None for r in few)
    assert quality_verdicts(frame(spark, clean[:1]).limit(0)).count() == 0


def test_small_groups_are_judged_by_their_language(spark):
    clean = [sentences(i, 60 + i % 90) for i in range(340)]
    junk = [" ".join(w + "###$$$" for w in words(1000 + i, 120)) for i in range(70)]
    rows = [(i, t, "en", "large" if i < 300 else "rare" if i < 320 else "new") for i, t in enumerate(clean)]
    rows += [(1000 + i, t, "en", "rare" if i < 60 else "new") for i, t in enumerate(junk[:65])]
    rows += [(2000 + i, t, "xx", "new") for i, t in enumerate([clean[0], *junk[65:]])]
    got = {r.doc_id: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert {k for k, r in got.items() if r.kept} == {*range(340), 2000}  # a rare source of mostly junk, and a rare language


def test_repeats_alone_reject(spark):
    w = [words(5000 + i, 220) for i in range(403)]
    texts = [" ".join(x) for x in w[:400]]
    texts.append(" ".join(w[400][:110]) + "\nmenus" * 100)  # 99 % of the lines, 48 % of the words
    texts.append("\n".join(f"{a} {b}\nhomes\nabout" for a, b in zip(w[401][:110:2], w[401][1:110:2])))  # two thirds of the lines alone
    texts.append(" ".join([*w[402][:110], *w[402][110:155], *w[402][110:155]]))  # 45 % of the words alone
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {k for k in got if not got[k].kept} == {400, 401, 402}
    assert not any(r.base_failed for r in got.values())


# Licences


def test_license_scan(spark):
    mit = "\n\n".join(LICENSES["MIT"])
    texts = [*ODD, mit, "Copyright (c) 2020 Some One\n" + mit.upper(), mit.replace('"', "“").replace("sublicense", "sub-licence").replace("\n", "\r\n"),
             "// MIT License\n//\n// Copyright 1999, A. B.\n// All rights reserved.\n//\n" + "\n".join("// " + x for x in LICENSES["MIT"][1].split("\n")),
             mit + " and more", mit + " 東", LICENSES["ISC"][1], "Released under the MIT License.", "Released under the MIT License. Or not."]
    df = frame(spark, texts)
    got = license_scan(df, "doc_id", "text", known_licenses(spark)).collect()
    found = {r.doc_id - len(ODD): r.license_id for r in got if r.license_id}
    assert found == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 6: "ISC"} and len(got) == len(texts) + 1
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841  read by the SQL
    sql = duckdb.sql(license_scan_sql()).fetchall()
    assert sorted(sql) == sorted(map(tuple, got))


def test_long_licenses(spark):
    want = [(name, text) for name, text in long_texts()] + [("Unlicense", LICENSES["Unlicense"][1])]
    want += [("Apache-2.0", "Copyright 2020 Some One\n\n" + next(t for n, t in want if n == "Apache-2.0").upper().replace("\n", "\r\n"))]
    assert {n for n, _ in want} >= {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"}
    df = frame(spark, [t for _, t in want] + [want[0][1] + " and more"])
    got = license_scan(df, "doc_id", "text", known_licenses(spark)).collect()
    assert {r.doc_id: r.license_id for r in got} == {**{i: n for i, (n, _) in enumerate(want)}, len(want): None}
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841  read by the SQL
    assert sorted(duckdb.sql(license_scan_sql()).fetchall(), key=str) == sorted(map(tuple, got), key=str)


# Passages


def test_bands_and_links():
    assert tune_bands(0.8, 3, 0.998) == 9
    sets = [frozenset(range(i, i + 20)) for i in (0, 2, 4, 40, 41, 100)]
    links = linked(list(range(6)), sets, 0.8)
    assert brute_components(list(range(6)), lambda a, b: (a, b) in links or (b, a) in links) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_repeated_passages(spark):
    passage, line = sentences(1, 64), sentences(2, 80).replace(". ", " ")
    swap = line.split()
    swap[40] = "changed"
    texts = [sentences(10, 200), sentences(11, 96) + " begin " + passage + " " + sentences(12, 80), sentences(13, 40) + "\n" + line + "\n" + sentences(14, 40),
             "go on " + passage + " " + sentences(15, 120), sentences(16, 48) + "\n" + " ".join(swap) + "\nend.", sentences(17, 300), passage[:120], *ODD]
    got = repeated_passages(frame(spark, texts, 1), "doc_id", "text").collect()
    by_doc = {(r.doc_id, r.removed): r for r in got}
    assert {(2, False), (3, False), (4, True), (5, True)} <= by_doc.keys()
    assert {r.doc_id for r in got} & {6, 7} == set()
    assert not any(r.removed for r in got if r.doc_id == 1)  # the repeated row is its own copy
    assert by_doc[4, True].first_doc_id == 2 and by_doc[5, True].first_doc_id == 3
    cut = {r.doc_id: r for r in without_repeats(frame(spark, texts, 1), "doc_id", "text").collect()}
    assert passage[80:] not in cut[4].text and cut[4].text.startswith("go on") and cut[4].text.endswith(texts[3][-60:])
    assert "changed" not in cut[5].text and cut[5].text.endswith("\nend.")
    assert all(cut[i].text == texts[i - 1] for i in (1, 2, 3, 6, 7)) and cut[1].component == "x"
    assert repeated_passages(frame(spark, texts).limit(0), "doc_id", "text").count() == 0


def test_anchors_meet_in_any_fifty_words():
    texts = ["", "a", " ".join(words(1, 49)), "É\u2003ß " + " ".join(words(2, 300)), "tok " * 400, " \n" + "\n".join(words(3, 50)), " ".join(words(4, 25))]
    which, starts, stops, hashes = anchors(texts, 25)
    spans = collections.defaultdict(list)
    for t, a, b, h in zip(which, starts, stops, hashes):
        assert len(texts[t][a:b].split()) == 25 and texts[t][a:b].strip() == texts[t][a:b]
        spans[t].append((a, b, h))
    assert set(spans) == {3, 4, 5} and all(a[1] <= b[0] for a, b in zip(spans[4], spans[4][1:]))
    rng = np.random.default_rng(0)
    shared = words(9, 400)
    for _ in range(300):  # any cut of 50 words, in any surroundings
        at = rng.integers(0, 350)
        left, right = (" ".join([*words(rng.integers(1 << 30), 60), *shared[at:at + 50], *words(rng.integers(1 << 30), 60)]) for _ in range(2))
        assert set(anchors([left], 25)[3]) & set(anchors([left, right], 25)[3][anchors([left, right], 25)[0] == 1])


def test_passages_cut_in_mid_sentence(spark):
    def prose(seed, n, sentence):
        w = words(seed, n)
        return " ".join(" ".join(w[i:i + sentence]) + "." for i in range(0, n, sentence))

    rows, shapes = [], []
    for sentence in (12, 20, 25, 1000):
        for k in range(10):
            seed = 100 * sentence + 10 * k
            passage = prose(seed, 400, sentence).split(" ")[k + 3:k + 53]
            for half in (1, 2):
                rows.append((len(rows), f"{prose(seed + half, 70, sentence)[:-9]} {' '.join(passage)} {prose(seed + half + 2, 70, sentence)[5:]}"))
            shapes.append(len(rows) - 1)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").where("removed").collect()
    assert {r.doc_id for r in got} == set(shapes)
    assert all(r.first_doc_id == r.doc_id - 1 for r in got)


def test_many_copies_keep_one(spark):
    rows = [(i, sentences(50, 40) + ("" if i % 3 else " " + words(i, 1)[0])) for i in range(60)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id for r in got if r.removed} == set(range(1, 60)) and {r.first_doc_id for r in got} == {0}


def test_null_keys_leave_near_copies_linked(spark):
    line = words(60, 90)
    near = " ".join([*line[:45], "changed", *line[46:]])
    rows = [(None, " ".join(line)), (1, " ".join(line)), (2, near)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert any(r.doc_id == 2 and r.removed and r.n_chars == len(near) for r in got)
    keyed = [(1, " ".join(words(61, 90))), (1, " ".join(line)), (2, near)]  # another text under the same key
    for rows in (keyed, [keyed[1], keyed[0], keyed[2]]):
        got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
        assert any(r.doc_id == 2 and r.removed and r.n_chars == len(near) for r in got)


# Pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality_verdicts(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if verdict[r.doc_id]}
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    label = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    texts = {k: t for k, t in texts.items() if label[k] == k}
    left = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    texts = {r.doc_id: r.text for r in without_repeats(left, "doc_id", "text").collect()}
    counted = token_counts(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), "doc_id", "text", corpus_pipeline.BYTE_BPE)
    want = {r.doc_id: r.n_tokens + 1 for r in counted.collect()}
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.limit(0) if stage is corpus_pipeline.repeated_passages else docs
    assert corpus_pipeline.packed(spark, docs, sf_dir).count() == 0


def test_stages_stand_any_columns_and_keys(spark, sf_dir):
    """Extra columns with the operators' own names, null keys, and different texts under one key: no row is lost without reason."""
    good = [" ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(words(seed, 80))) for seed in range(70)]
    keys = [None, None, 4, 4, 4, (1 << 62) + 1] + list(range(100, 164))
    rows = [(k, t, "en", "s", len(t), "x", 1, 2, "k", 3) for k, t in zip(keys, good)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _kept string, _own long, _first long, _key string, _gone int"
    docs = spark.createDataFrame([*rows, (4, "too short", "en", "s", 9, "x", 1, 2, "k", 3), (None, good[0], "en", "s", 1, "y", 0, 0, "", 0)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        found = collections.Counter(r["text"] for r in after.collect())
        want = collections.Counter(good)
        if name == "quality rules":
            want[good[0]] += 1  # the copy goes in the next stage
        assert found == want, name
        docs = after


def test_own_keys(spark):
    rows = [(k, i) for i, k in enumerate([None, 1, 2, 2, None, 3, 1 << 62, -5])]
    got = with_own_key(spark.createDataFrame(rows, "doc_id long, _repeated int"), "doc_id", "own").collect()
    assert len({r["own"] for r in got}) == len(rows)
    assert {r["doc_id"]: r["own"] for r in got if r["own"] < 1 << 62} == {1: 1, 3: 3, -5: -5}


def test_statistics_meet_rows_where_they_are(spark, monkeypatch):
    """By a broadcast, or by salt and group: the same rows, and no task gets a whole group."""
    rows = quality_rules.stage(spark.range(3000).selectExpr("IF(id < 2900, 'hot', concat('g', id)) AS grp", "id"), "t")
    stats = quality_rules.stage(rows.groupBy("grp").count(), "t")
    want = sorted(map(tuple, rows.join(stats, "grp").select("grp", "id", "count").collect()))
    for bound in (20_000, 3):
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", bound)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            joined = quality_rules.with_statistics(rows, stats)
            assert sorted(map(tuple, joined.select("grp", "id", "count").collect())) == want
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(grp#" not in plan or "_salt" in plan
            most = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert most < 2900
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.set("spark.sql.adaptive.enabled", "true")


# Substring dedup as a whole


def brute_units(texts, width):
    """Lines, sentence passages and anchors of each text, by plain loops: (doc, start, stop, what makes it equal to others, words)."""
    out = []
    for doc, text in texts:
        found = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        own = [text[a:b].lower() for a, b in found]
        n = len(own)
        line_of = [text.count("\n", 0, a) for a, _ in found]
        lines = {}
        for i, line in enumerate(line_of):
            lines.setdefault(line, []).append(i)
        whole = set()
        for line, at in lines.items():
            if len(at) >= width:
                start = 0 if line == 0 else [m.end() for m in re.finditer("\n", text)][line - 1]
                end = text.find("\n", found[at[0]][0])
                out.append((doc, start, len(text) if end < 0 else end, tuple(own[at[0]:at[-1] + 1]), True))
                whole.add((at[0], at[-1] + 1))
        ends = [i + 1 for i in range(n) if i + 1 == n or own[i][-1] in ".!?" or line_of[i + 1] != line_of[i]]
        for start in [0, *ends[:-1]] if n else []:
            stop = next((e for e in ends if e >= start + width), None)
            if stop and (start, stop) not in whole:
                out.append((doc, found[start][0], found[stop - 1][1], tuple(own[start:stop]), False))
        windows = [int(run_hashes(WordHashes().of(own[i:i + width]), np.array([width]))[0]) for i in range(n - width + 1)]
        mixed = [int(paragraph_dedup._mix(np.array([h], np.uint64) ^ paragraph_dedup._ANCHORED)[0]) for h in windows]
        chosen = {i + j for i in range(len(mixed) - width) for j in range(width + 1) if mixed[i + j] == min(mixed[i:i + width + 1])}
        last = {}
        for i in sorted(chosen):
            if last.get(mixed[i], -width) + width <= i:
                last[mixed[i]] = i
                out.append((doc, found[i][0], found[i + width - 1][1], ("anchor", *own[i:i + width]), False))
    return out


def brute_passages(texts, similarity=0.8, width=25):
    """Every pair of lines compared, equal units joined; what stays is the first of a component."""
    rows = brute_units(texts, width)
    classes = sorted({r[3] for r in rows})
    shingles = {r[3]: {r[3][i:i + 5] for i in range(len(r[3]) - 4)} for r in rows if r[4]}
    links = {c: c for c in classes}

    def root(c):
        while links[c] != c:
            c = links[c]
        return c

    for a in shingles:
        for b in shingles:
            if a < b and len(shingles[a] & shingles[b]) >= similarity * len(shingles[a] | shingles[b]):
                links[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for doc, start, stop, words_, _ in rows:
        groups[root(words_)].append((doc, start, stop))
    return sorted((*unit, min(g)[0], unit != min(g)) for g in groups.values() if len(g) > 1 for unit in g)


def test_substring_dedup_against_all_pairs(spark):
    """300 documents with copied lines, near copies, and passages put inside other lines: all units, their first places and what goes."""
    rng = np.random.default_rng(9)
    pool = [words(int(s), 70) for s in range(40)]

    def line(w):
        return " ".join(x + ("." if i % 11 == 10 else "") for i, x in enumerate(w))

    def near(w):
        at = int(rng.integers(5, len(w) - 5))
        return [*w[:at], "changed", *w[at + 1:]]  # five shingles of about 66: similarity 0.85

    texts = []
    for doc in range(300):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            w, kind = pool[int(rng.integers(0, 40))], int(rng.integers(0, 4))
            own = words(1000 + 7 * doc + len(parts), 40)
            start = int(rng.integers(0, 15))
            parts.append([line(w), line(near(w)), line(own), line(own[:13] + w[start:start + 54] + own[13:])][kind])
        texts.append((doc, "\n".join(parts)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, paragraph_dedup.repeated_units(df, "doc_id", "text").collect()))
    assert got == brute_passages(texts) and len(got) > 300
