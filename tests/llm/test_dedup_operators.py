"""Substring, SimHash and embedding deduplication and decontamination, scans and URL filters against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from churnforge.llm import decontam, embdedup, licenses, simhash, substrings, urlfilter
from churnforge.llm.components import connected_components
from tests.conftest import SF001
from tests.llm import brute


def frame(spark, rows, schema="doc_id long, text string"):
    """A table with columns whose names operators use inside."""
    return spark.createDataFrame(rows, schema).select("*", *[
        F.lit(k).alias(c) for k, c in enumerate("id body block fp n key rank word start label2 least node i".split())])


def passages(seed, n=40):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcde") + str(rng.randint(0, 9)) for _ in range(30)) for _ in range(4)]
    out = []
    for k in range(n):
        body = [rng.choice("xyz") + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            cut = rng.choice(shared).split()
            a = rng.randint(0, 20)
            body[len(body) // 2:len(body) // 2] = cut[a:a + rng.randint(3, 10)]
        if rng.random() < 0.3:
            body += body[:12]
        out.append((k, rng.choice([" ", "\n", "  \t"]).join(body)))
    return out + [(100, None), (101, ""), (102, " \n "), (103, out[1][1]), (103, out[1][1]), (None, out[2][1] + " é ß"),
                  (104, "same " * 50_000), (105, "É é K k İ")]


@pytest.mark.parametrize("config", [
    substrings.SubstringConfig(words=6, block_bytes=300, group_suffixes=20), substrings.SubstringConfig(words=6),
    substrings.SubstringConfig(words=6, block_bytes=300, group_suffixes=20, cell_bits=2)])
def test_repeats_against_all_windows(spark, config):
    rows = passages(1)
    want = [(i, len(w), sum(c), " ".join(x for x, gone in zip(w, c, strict=True) if not gone))
            for (i, _), (w, c) in zip(rows, brute.repeats([t for _, t in rows], 6), strict=True)]
    out = substrings.remove_repeats(frame(spark, rows).repartition(3), config=config).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out), key=key) == sorted(want, key=key)
    for r in out:
        assert sum(s["last_word"] - s["first_word"] + 1 for s in r["spans"]) == r["n_removed"]


def test_large_cells_are_split_by_path(spark):
    """The plan keeps its size, groups keep theirs, and no two cells share a group's number by accident."""
    docs = frame(spark, passages(3, 400)).select("doc_id", "text").where("doc_id <> 104")
    config = substrings.SubstringConfig(words=6, group_suffixes=50, cell_bits=3)
    plan, _ = substrings.plan_prefixes(docs, "text", config, 4)
    assert plan.cell_bits == 3 and all(len(t) == 8 for t in plan.groups) and plan.splits.max() > 1
    block = substrings.Block.of(pa.array([r["text"] for r in docs.collect()], pa.string()), 6)
    group, path = plan.route(block.seq, block.at), block.seq.fingerprint(block.at, 6)
    assert (group >= 0).all() and np.bincount(group).max() < 250
    assert len(set(zip(group.tolist(), path.tolist(), strict=True))) == len(np.unique(path))     # equal paths, one group


def test_repeats_carry_all_columns_and_take_an_empty_table(spark):
    df = frame(spark, passages(2)[:5])
    out = substrings.remove_repeats(df, carry=True)
    assert out.select("text", "carried.*").columns == ["text", *(c for c in df.columns if c != "text")] and out.count() == 5
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(200, 200 + k) for k in range(50)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    nodes = sorted({x for e in edges for x in e})
    roots = brute.components(len(nodes), lambda i, j: (nodes[i], nodes[j]) in near)
    want = {n: nodes[r] for n, r in zip(nodes, roots, strict=True) if any(a == n != b for a, b in near)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(seed, n=60):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") * rng.randint(1, 6) + str(rng.randint(0, 99)) for _ in range(150)]
    rows = []
    for k in range(n):
        words = list(base) if k % 3 else [str(rng.random()) for _ in range(20)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = str(rng.random())
        rows.append((k, " ".join(words)))
    return rows + [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (203, "ONE  two"), (None, rows[1][1]),
                   (None, "nothing like it"), (204, "É x"), (205, "é x"), (206, "w " * 100_000)]


@pytest.mark.parametrize("rows_a_cell", [2_048, 33])
def test_simhash_groups_against_all_pairs(spark, rows_a_cell, monkeypatch):
    monkeypatch.setattr(simhash, "SHORT_RUN", 4)
    rows = near_copies(5)
    fps = [brute.fingerprint(t) for _, t in rows]
    roots = brute.components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    want = list(zip([i for i, _ in rows], fps, brute.least_ids([i for i, _ in rows], roots), strict=True))
    out = simhash.simhash_groups(frame(spark, rows), config=simhash.SimHashConfig(cell_rows=rows_a_cell)).collect()
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows_a_cell", [2_048, 40])
def test_links_of_dense_groups(spark, rows_a_cell):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 62, 3)
    fps = {int(c) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
           for c in centre for _ in range(120)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), simhash.SimHashConfig(cell_rows=rows_a_cell))
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    roots = brute.components(len(fps), lambda i, j: ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 4)
    groups = {}
    for f, r in zip(fps, roots, strict=True):
        groups.setdefault(r, []).append(f)
    for group in groups.values():
        assert len({got.get(f, f) for f in group}) == 1
    assert len({got.get(g[0], g[0]) for g in groups.values()}) == len(groups)


def test_manhattan_distance_of_embeddings_is_a_lower_bound():
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    counts = lambda x: ((x[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3))
    plain = lambda x: ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).reshape(-1, 32, 2).sum(2)
    assert np.array_equal(counts(simhash._embed(a)), plain(a))
    want = np.abs(plain(a).astype(int) - plain(b).astype(int)).sum(1)
    got = simhash._manhattan(simhash._embed(a), simhash._embed(b))
    assert np.array_equal(got, want) and (got <= np.bitwise_count(a ^ b)).all()


def test_simhash_keeps_one_of_each_group(spark):
    rows = near_copies(8)
    df = frame(spark, rows)
    kept = simhash.simhash_keep(df)
    groups = simhash.simhash_groups(df)
    assert kept.columns == df.columns
    assert kept.count() == groups.select("component_fp").distinct().count()
    assert simhash.simhash_keep(df.limit(0)).count() == 0
    plain = frame(spark, [r for k, r in enumerate(near_copies(8, 30)) if r[0] is not None and r[0] != 203])
    fps = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(plain).collect()}
    assert sorted(r["doc_id"] for r in simhash.simhash_keep(plain).collect()) == sorted(set(fps.values()))


def test_contamination_against_all_places(spark):
    rng = random.Random(9)
    vocabulary = ["the", "of", "É", "é", "K9", "zeta", "İx"]
    body = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, body(rng.choice([0, 1, 2, 3, 5, 12]))) for k in range(12)] + [(3, "the of the of"), (None, body(5)), (50, None)]
    rows = [(k, body(rng.randint(0, 40))) for k in range(40)] + [
        (100, None), (101, ""), (102, "!?"), (7, "THE of"), (7, "THE of"), (None, items[5][1]), (103, " k9 \u212a9 " * 20_000)]
    config = decontam.DecontaminationConfig(window=4)
    for bound in (300_000, 0):
        out = decontam.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"),
                                          config=decontam.DecontaminationConfig(window=4, broadcast_rows=bound)).collect()
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out), key=str)
        assert got == sorted(((i, *brute.contamination(t, items, 4)) for i, t in rows), key=str)
    none = decontam.find_contamination(frame(spark, rows), spark.createDataFrame([], "item_id long, text string"), config=config)
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)
    assert decontam.find_contamination(frame(spark, rows).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("stretch", [1_024, 1])
def test_license_scan_against_all_windows(spark, stretch, monkeypatch):
    monkeypatch.setattr(licenses, "STRETCH_WORDS", stretch)
    notices = list(licenses.TEMPLATES.values()) + list(licenses.PHRASES)
    rng = random.Random(10)
    rows = []
    for k in range(60):
        words = rng.choice(notices).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["foo", "THE", "license", "MIT"])
        rows.append((k, "Intro.\n" + rng.choice([" ", ", "]).join(words).upper() + "\nend " + rng.choice(notices)))
    rows += [(100, None), (101, ""), (102, "mit\nlicense MIT-License"), (103, "\u212a LİCENSE mit licen\u017fe"), (7, "x"), (7, "x"),
             (None, "GNU General Public License"), (104, "apache " * 50_000 + "license")]
    out = licenses.scan_licenses(frame(spark, rows)).collect()
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in out]
    want = []
    for i, t in rows:
        n, places, base, labels, score = brute.licenses(t, licenses.PHRASES, licenses.TEMPLATES, 0.8)
        want.append((i, n, len(places), places[0] if places else None, places[-1] if places else None, base, labels, round(score, 9)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan_licenses(frame(spark, rows).limit(0)).count() == 0


def test_notices_across_lines_and_scattered_words(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    gpl = "This work is licensed\nunder the GNU General\nPublic License, version 3."
    scattered = "word " * 30 + "released " + "word " * 200 + "under " + "word " * 200 + "the " + "word " * 30 + "license"
    rows = [(1, bsd), (2, gpl), (3, scattered), (4, "x " * 500 + bsd + " y" * 500), (5, ("the of to " * 3_000) + gpl)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: ["redistribution-notice"], 2: ["gpl", "gpl-notice"], 3: [], 4: ["redistribution-notice"], 5: ["gpl", "gpl-notice"]}


@pytest.mark.parametrize("bound", [300_000, 0])
def test_a_sigma_is_one_letter_wherever_it_stands(spark, bound):
    rows = [(1, "ΜΕΓΑΣ.ΑΒ ΓΔ ΕΖ ΗΘ"), (2, "ΜΕΓΑΣ:ΑΒ ΓΔ ΕΖ ΗΘ"), (3, "ΜΕΓΑΣ ΑΒ ΓΔ ΕΖ ΗΘ"), (4, "μεγας αβ γδ εζ ηθ"), (5, "ΜΕΓΑς ΑΒ ΓΔ ΕΖ ΗΘ")]
    items = spark.createDataFrame([(1, "ΜΕΓΑΣ ΑΒ ΓΔ ΕΖ ΗΘ")], "item_id long, text string")
    out = decontam.find_contamination(frame(spark, rows), items, config=decontam.DecontaminationConfig(broadcast_rows=bound)).collect()
    assert {r["doc_id"]: r["n_hit"] for r in out} == {1: 5, 2: 5, 3: 5, 4: 0, 5: 0}     # only A-Z are the same as a-z


def vectors(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = []
    for k in range(n):
        v = centres[k % 12] + rng.standard_normal(dim) * rng.choice([0.05, 0.25, 1.0])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 12 % 3)))
    nan, inf = float("nan"), float("inf")
    return rows + [(500, None, 0), (501, [0.0] * dim, 0), (502, [nan] + [1.0] * (dim - 1), 0), (503, [inf] + [1.0] * (dim - 1), 0),
                   (504, rows[0][1], None), (505, rows[0][1], rows[0][2]), (506, rows[0][1][:4], rows[0][2]), (507, [], 0),
                   (508, [None] + [1.0] * (dim - 1), 0), (3, rows[3][1], rows[3][2]), (None, rows[3][1], rows[3][2]),
                   (None, [9.0] + [-1.0] * (dim - 1), 1), (509, [1e30 * x for x in rows[0][1]], rows[0][2])]


@pytest.mark.parametrize("block", [2_048, 40])
def test_embedding_links_against_all_pairs(spark, block):
    rows = vectors(11)
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v)
          for _, v, label in rows]
    linked = lambda i, j: (ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])
                           and brute.cosine(rows[i][1], rows[j][1]) >= 0.93)
    roots = brute.components(len(rows), linked)
    least = brute.least_ids([r[0] for r in rows], roots)
    want = [(r[0], sum(linked(i, j) for j in range(len(rows)) if j != i), least[i], r[0] == least[i]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("id", F.lit(2))
    out = embdedup.embedding_links(df, config=embdedup.EmbeddingConfig(block=block, strip=16)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert embdedup.embedding_links(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(12)
    x = embdedup.unit(rng.standard_normal((400, 64)) * rng.choice([0.01, 1, 100], (400, 64)))
    q, s, e = embdedup.quantise(x)
    near = (q.astype(np.int64) @ q.T.astype(np.int64)) * np.outer(s, s)
    assert (np.abs(x @ x.T - near) <= e[:, None] + e + np.outer(e, e) + 1e-9).all()


URLS = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/a", "http://www.example.com/en/", "https://a.www.example.com/en/x?y",
        "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/es", "http://x.net?q=/es/", "http://x.org/en/",
        "ftp://u@example.com:80/en/", "http://a..net/fr/#t", "http://example.com/EN/", "http://é.net/es/é", "a://b://c.net/es/",
        "http://example.com\n/en/", "http://x.net/es/" + "y" * 50_000]


@pytest.mark.parametrize("bits", [10, 1])
def test_url_filter_against_all_rules(spark, bits):
    rules = urlfilter.RULES + [("org", "", "block"), ("y.org", "/é", "allow")] + [(f"h{k}.com", "/", ("allow", "block")[k % 2]) for k in range(200)]
    urls = URLS + [f"http://{a}h{k}.com/{k}" for k in range(0, 400, 3) for a in ("", "s.")] + ["http://y.org/éa"]
    rows = [(k if k != 4 else None, u) for k, u in enumerate(urls)] + [(5, URLS[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", F.lit("x").alias("host"), F.lit("y").alias("key"), F.lit(1).alias("id"))
    out = urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, rules + rules[:3]), config=urlfilter.CascadeConfig(bits_per_key=bits, hashes=2 if bits == 1 else 5))
    want = [(i, *(x if x[3] else (*x[:3], "allow"))) for i, u in rows for x in [brute.url(u, rules)]]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.rules_frame(spark, rules)).count() == 0
    nothing = urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, rules).limit(0))
    assert {(r["rule"], r["verdict"]) for r in nothing.collect()} == {(None, "allow")}


def test_keys_beyond_a_level_go_to_several_cascades(spark):
    """Small levels: many segments, the same answers; a host with very many labels is one url like any other."""
    rules = urlfilter.RULES + [(f"h{k}.com", "/" * (k % 3), ("allow", "block")[k % 2]) for k in range(60)] + [("a.b.c.d.org", "/x", "block")]
    urls = URLS + [f"http://{a}h{k}.com//{k}" for k in range(120) for a in ("", "s.")] + ["http://" + "l." * 3_000 + "a.b.c.d.org/x/y"]
    rows = list(enumerate(urls))
    out = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urlfilter.rules_frame(spark, rules),
                                config=urlfilter.CascadeConfig(bits_per_key=6, hashes=3, max_bits=128))
    want = [(i, *(x if x[3] else (*x[:3], "allow"))) for i, u in rows for x in [brute.url(u, rules)]]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_cascade_is_exact_for_its_whole_universe(spark):
    keys = spark.range(5_000).select(F.concat(F.lit("k"), "id").alias("key")).select("key", *urlfilter._hashed(F.col("key")))
    listed = keys.where("cast(substring(key, 2) as int) % 7 = 0")
    cascade = urlfilter.build_cascade(listed, keys, urlfilter.CascadeConfig(bits_per_key=3, hashes=2))
    rows = keys.collect()
    inside = cascade.contains(np.array([r["h1"] for r in rows]), np.array([r["h2"] for r in rows]))
    assert len(cascade.levels) > 2
    assert [int(r["key"][1:]) % 7 == 0 for r in rows] == inside.tolist()


def test_simhash_query_on_the_given_table(spark):
    from churnforge.llm.catalog import op10_simhash_dedup
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    fps = [brute.fingerprint(t) for _, t in rows]
    roots = brute.components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    want = {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute.least_ids([i for i, _ in rows], roots), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op10_simhash_dedup(spark, SF001).collect()} == want


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_links_of_dense_groups_at_odd_distances(spark, bits):
    rng = np.random.default_rng(16)
    fps = {int(c) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, bits + 1), replace=False)))
           for c in rng.integers(0, 1 << 62, 2) for _ in range(90)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), simhash.SimHashConfig(cell_rows=36, max_bits=bits))
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    roots = brute.components(len(fps), lambda i, j: ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= bits)
    groups = {}
    for f, r in zip(fps, roots, strict=True):
        groups.setdefault(r, []).append(f)
    for group in groups.values():
        assert len({got.get(f, f) for f in group}) == 1
    assert len({got.get(g[0], g[0]) for g in groups.values()}) == len(groups)
