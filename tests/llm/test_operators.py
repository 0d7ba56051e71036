from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeworks.llm import _io, _joins, bpe, decontam, langid, lengths, line_dedup, multiset_hash, queries, secrets, sharding, simhash, wacz
from tests.llm.corpus import corpus, frame

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture
def docs(spark):
    return frame(spark)


@pytest.fixture
def none(spark):
    return frame(spark, [])


# 1


def plain_base(text: str) -> list[tuple]:
    kinds = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0, 18, 0), ("hex", r"[0-9a-f]+", 0, 16, 0))
    out = []
    for rank, (kind, p, group, least, flags) in enumerate(kinds):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(p, text, flags) if len(m[group]) >= least]
    return sorted(out)


def test_secret_spans_are_those_of_a_plain_scan(docs):
    got = Counter((r["doc_id"], tuple((s["start"], s["rank"], s["kind"], s["end"]) for s in r["base"])) for r in secrets.secret_spans(docs).collect())
    assert got == Counter((d, tuple(plain_base(t or ""))) for d, t, *_ in corpus())


def test_live_values_are_one_owners(spark, docs):
    rows = [(1, "key Ab3xYz9QwErTy7UiOpLk here", None, "a", 0), (2, "key Ab3xYz9QwErTy7UiOpLk here", None, "a", 0), (3, "Qq3xYz9QwErTy7UiOpLk", None, "a", 0), (4, "Qq3xYz9QwErTy7UiOpLk too", None, "b", 0), (5, "Example9QwErTy7UiOpLk", None, "c", 0)]
    rows += [(6, "copied Zz3xYz9QwErTy7UiOpLk", None, "a", 0), (7, "copied Zz3xYz9QwErTy7UiOpLk", None, "b", 0)]
    rows += [(10 + k, f"text {k} of Vv3xYz9QwErTy7UiOpLk", None, "a", 0) for k in range(10)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["live"]] for r in secrets.secret_spans(frame(spark, rows)).collect()}
    # one text's copy with one other owner doesn't count; ten texts of one owner do
    assert {k: v for k, v in got.items() if k < 10} == {1: [("live", 4, 24)], 2: [("live", 4, 24)], 3: [], 4: [], 5: [], 6: [("live", 7, 27)], 7: [("live", 7, 27)]}
    assert not any(v for k, v in got.items() if k >= 10)
    classes = {r["n_owners"]: r["class"] for r in secrets.ownership(secrets.scan(frame(spark, [(k, "token = Zx81kkqLmN77pQ", None, f"o{k}", 0) for k in range(3)]))).collect()}
    assert classes == {3: "example"}


def test_long_runs_are_candidates(spark):
    long = "".join(sha(f"{k}")[:9] + "Q" for k in range(40))
    plain = "q" * 300
    rows = [(1, f"é {long} end", None, "a", 0), (2, f"{plain} {'Ab3xYz9QwErTy7UiOpLk'}", None, "b", 0)]
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["live"]] for r in secrets.secret_spans(frame(spark, rows)).collect()}
    assert got == {1: [(2, 402)], 2: [(301, 321)]}


def test_ownership_counts_distinct_repositories_and_keeps_no_value(spark):
    value = "Zx81kkqLmN77pQwErTy0"
    rows = [(1, f"token = {value}", "shared", "a", 0), (2, f"token = {value} x", "shared", "b", 0), (3, f"token = {value} y", "own", "b", 0), (4, f"token = {value} y", None, None, 0)]
    found = secrets.scan(frame(spark, rows), repository="lang")
    got = secrets.ownership(found).collect()
    assert [(r["n_owners"], r["n_repositories"], r["n_texts"], r["n_candidates"], r["class"]) for r in got] == [(3, 3, 3, 8, "example")]
    assert not any(value in str(r) for r in found.collect())


def test_places_of_many_matches(spark):
    """Matches of one text by the tens of thousands take time in proportion, or nearly."""
    parts = [f"{sha(str(k))[:16]}{'é' * (k % 5)} " for k in range(40_000)]
    text = "".join(parts)
    began = time.time()
    row = secrets.secret_spans(frame(spark, [(1, text, None, "a", 0), (2, None, None, None, 0)])).where("doc_id = 1").first()
    assert time.time() - began < 60
    assert [(s["start"], s["end"]) for s in row["base"]] == [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]


# 2


def plain_print(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, list]) -> dict[int, object]:
    keys, up = [*prints], {k: k for k in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    groups = defaultdict(list)
    for k in keys:
        groups[root(k)] += prints[k]
    return {k: min((x for x in groups[root(k)] if x is not None), default=None) for k in keys}


def check_components(rows, found):
    prints = defaultdict(list)
    for i, t in rows:
        prints[plain_print(t)].append(i)
    want = plain_components(prints)
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found) == Counter((i, plain_print(t), want[plain_print(t)]) for i, t in rows)


def test_simhash_components_are_those_of_all_pairs(docs):
    check_components([(r[0], r[1]) for r in corpus()], simhash.near_duplicates(docs).collect())


@pytest.mark.parametrize("block, few, pivots", [(3, 100_000, 16), (3, 0, 1), (20, 100_000, 2), (64, 0, 16), (4096, 100_000, 16)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, block, few, pivots):
    """Random fingerprints around a few centres: dense buckets, blocks of a few members, few pivots, large buckets by shuffle."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    r = np.random.default_rng(1)
    centres = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = {int(c) for c in centres} | {int(v) for v in r.integers(0, 1 << 63, 200, dtype=np.uint64)}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in r.integers(0, 64, r.integers(1, 8)):
                x ^= 1 << int(b)
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.components(simhash.links(simhash.entries(spark.createDataFrame([(v,) for v in signed], "fp long")), simhash.Ring())).collect()
    want = plain_components({v: [v] for v in values})
    groups = defaultdict(set)
    for row in got:
        groups[row["root"]].add(row["node"] & (1 << 64) - 1)
    by = defaultdict(set)
    for v, root in want.items():
        by[root].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in by.values() if len(g) > 1)


def test_small_tables_take_few_files_whatever_the_partitions(spark, docs, monkeypatch):
    """Each file of a table costs an executor a process; a row for each of 48 partitions has to end in one file, bar the first links."""
    files = []

    def counted(df, name, *rows):
        table = _io.written(df, name, *rows)
        files.append((name, len(list(Path(urlsplit(table._written_to).path).glob("*.parquet")))))
        return table

    monkeypatch.setattr(simhash, "written", counted)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check_components([(r[0], r[1]) for r in corpus()], simhash.near_duplicates(docs).collect())
        first = files.index(next(x for x in files if x[0] == "edges"))
        assert [n for k, (name, n) in enumerate(files) if name in ("distinct", "edges", "rooted") and k != first and n > 1] == []
        # a bound over ROWS_A_FILE still deals the rows out
        monkeypatch.setattr(_io, "ROWS_A_FILE", 10)
        assert sorted(r["id"] for r in counted(spark.range(95).repartition(48, "id"), "many", 95).collect()) == list(range(95)) and files[-1][1] == 10
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_units_of_several_batches_keep_their_links():
    """A large unit that spans batches, between small ones."""
    import pyarrow as pa

    near = [(1 << 40) ^ (1 << k) for k in range(40)]
    rows = [(1, 0, 0, 5), (1, 0, 0, 7), *[(2, 0, 0, v) for v in near], *[(2, 0, 1, v ^ 3) for v in near], (3, 0, 0, 9), (3, 0, 1, 8)]
    rows = [(*r, r[3]) for r in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + 11]], pa.int64()) for k in range(5)], names=["key", "unit", "role", "id", "w0"]) for a in range(0, len(rows), 11)]
    old, simhash.BLOCK = simhash.BLOCK, 4
    try:
        got = {frozenset(map(int, p)) for left, right in simhash._unit_links(iter(batches), simhash.Ring()) for p in zip(left, right, strict=True)}
    finally:
        simhash.BLOCK = old
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in map(tuple, got):
        up[root(a)] = root(b)
    assert len({root(v) for v in [*near, *[v ^ 3 for v in near]]}) == 1 and root(5) == root(7) and root(8) == root(9)


def test_similar_documents_are_those_of_like_shingles(spark):
    """Copies with a few words changed go together; texts that share a passage alone don't."""
    import random

    r = random.Random(8)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(n)]
    rows, groups, passage = [], {}, words(60)
    for g in range(25):
        base = words(300)
        for k in range(4):
            text = list(base)
            for at in r.sample(range(300), 3 if k else 0):
                text[at] = f"changed{g}{k}{at}"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(text), None, None, 0))
    for _ in range(40):
        groups[len(rows)] = None
        rows.append((len(rows), " ".join([*words(150), *passage, *words(150)]), None, None, 0))
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(frame(spark, rows)).collect()}
    together = {i: min(j for j in groups if groups[j] == g) if g is not None else i for i, g in groups.items()}
    assert sum(got[i] == together[i] for i in got) >= 0.97 * len(rows)
    assert all(got[i] == i for i, g in groups.items() if g is None)
    stays = simhash.without_near_duplicates(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in stays) == sorted({*got.values()}) and all(r["text"] == rows[r["doc_id"]][1] for r in stays)
    odd = simhash.similar_documents(frame(spark)).collect()
    texts = {}
    for i, t, *_ in corpus():
        texts.setdefault(t or "", set()).add(i)
    assert len(odd) == len(corpus()) and all(len({x["component_id"] for x in odd if x["doc_id"] in ids and x["doc_id"] is not None}) <= 1 for ids in texts.values())


def test_likeness_of_minima_is_that_of_the_sets():
    """Pairs at some likenesses: most above the limit pass, few far below it."""
    r = np.random.default_rng(3)
    ring = simhash.WideRing(0.8)
    passed = {}
    for share in (0.6, 0.7, 0.8, 0.85, 0.9):
        hits = 0
        for _ in range(60):
            both = round(300 * 2 * share / (1 + share))
            whole = r.integers(0, 1 << 63, 600 - both, dtype=np.uint64)
            with np.errstate(over="ignore"):
                prints = [np.r_[np.array(simhash.wide_print(h), np.uint64), simhash.packed_minima(simhash.minima(h))] for h in (whole[:300], whole[300 - both : 600 - both])]
            hits += bool(ring.near(prints[0][None], prints[1][None], 0)[0])
        passed[share] = hits / 60
    assert passed[0.6] == 0 and passed[0.7] <= 0.15 and passed[0.8] >= 0.85 and passed[0.85] == passed[0.9] == 1


def test_unlike_texts_stay_whatever_their_ids(spark):
    r = np.random.default_rng(4)
    prose = lambda: " ".join(f"w{k}" for k in r.integers(0, 10**6, 60))
    one, two, three, four = (prose() for _ in range(4))
    rows = [(None, one, None, None, 0), (None, two, None, None, 0), (7, three, None, None, 0), (7, four, None, None, 0), (8, four, None, None, 0), (7, three, None, None, 0), (None, three + " end", None, None, 0), (9, None, None, None, 0), (10, "", None, None, 0)]
    got = Counter((x["doc_id"], x["text"]) for x in simhash.without_near_duplicates(frame(spark, rows)).collect())
    assert got == Counter([(None, one), (None, two), (7, three), (7, four), (9, None)])


# 3


def plain_lines(rows, min_docs=5, min_chars=40):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).encode().lower().decode()
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept)), "\n".join(kept)))
    return out


def test_line_dedup_is_that_of_a_plain_version(docs):
    want = plain_lines([(r[0], r[1]) for r in corpus()])
    got = line_dedup.keep_bitmaps(docs).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == Counter(w[:4] for w in want)
    assert any(w[2] for w in want)
    for r in got:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8))[: r["n_lines"]]
        assert r["n_lines"] - bits.sum() == r["n_dropped"]
    texts = line_dedup.without_repeated_lines(docs).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in texts) == Counter((w[0], w[4]) for w in want)


def test_lines_of_one_hash_over_many_partitions(spark):
    rows = [(k, "the very same line in every document of this table\n" + "own line number %d that nobody else has at all" % k, None, None, 0) for k in range(300)]
    docs = frame(spark, rows).repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = line_dedup.keep_bitmaps(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["doc_id"] for r in got if not r["n_dropped"]} == {299}


# 4


def test_fingerprints_are_of_multisets(spark):
    texts = ["one.\ntwo.\nthree.", "three.\none.\ntwo.", "one.\ntwo.\nthree.\nthree.", "", None]
    got = {r["doc_id"]: r for r in multiset_hash.fingerprints(frame(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)])).collect()}
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[2]["fingerprint"] and got[0]["lanes"] == got[1]["lanes"]
    assert got[3]["fingerprint"] == got[4]["fingerprint"] == "0" * 10 * multiset_hash.DENSE and got[3]["lanes"] == []
    one = multiset_hash.fingerprints(frame(spark, [(9, "three.", None, None, 0)])).select(F.col("dense").alias("b"))
    sums = spark.createDataFrame([(got[0]["dense"], got[2]["dense"])], "a array<long>, c array<long>").crossJoin(one)
    row = sums.select(multiset_hash.added(F.col("a"), F.col("b")).alias("x"), "c", multiset_hash.added(F.col("c"), F.col("b"), -1).alias("y"), "a").first()
    assert row["x"] == row["c"] and row["y"] == row["a"]
    lanes = "array<struct<lane:string,n:long,s:long>>"
    pairs = spark.createDataFrame([(i, j, got[i]["lanes"], got[j]["lanes"]) for i in range(5) for j in range(5)], f"i int, j int, a {lanes}, b {lanes}")
    near = {(r["i"], r["j"]): r["near"] for r in pairs.select("i", "j", multiset_hash.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    assert near[0, 1] == near[3, 4] == 1 and near[0, 2] == near[2, 0] == 0.75 and near[0, 3] == near[4, 2] == 0


def test_edits_are_those_of_a_plain_version(docs):
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        q = len(t) // 4
        want[i, len(t), sha(t[: len(t) - q] + rows[(k + 1) % len(rows)][1][:q])] += 1
    got = multiset_hash.with_edits(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def overlap(a: str, b: str) -> float:
    """The likeness of two texts' multisets of sentences."""
    x, y = [Counter(p for p in re.split(r"\n+|(?<=[.!?]) +", t) if p) for t in (a, b)]
    return sum((x & y).values()) / sum((x | y).values())


def test_likeness_is_the_overlap_at_any_length(spark):
    """From one sentence to three thousand, with many repeats, without cuts: near the share of sentences that both have."""
    word = lambda k: "w" + sha(str(k))[:7]
    sentences = lambda n, seed, of=10**9: " ".join(f"{word(k % of + seed)} {word(k % of + seed + 5000)}." for k in range(n))
    texts = [sentences(n, 20_000 * k) for k, n in enumerate((1, 20, 60, 200, 500, 1500, 3000))] + [sentences(400, 900_000, 40), sentences(300, 950_000)]
    run = lambda at: "".join(chr(0x4E00 + (at + k) * 7919 % 20000) for k in range(2000))
    uncut = [*(" ".join(word(k + at) for k in range(1000)) for at in (20_000_000, 30_000_000)), run(0), run(5000), "", None]
    rows = [*texts, *uncut]
    got = {r["doc_id"]: r for r in multiset_hash.with_edits(frame(spark, [(k, t, None, None, 0) for k, t in enumerate(rows)])).collect()}
    for k in range(1, len(texts) - 1):  # what follows the last has no sentences
        quarter = len(texts[k]) // 4
        assert abs(got[k]["near_edited"] - overlap(texts[k], texts[k][: len(texts[k]) - quarter] + rows[k + 1][:quarter])) < 0.03 and got[k]["near_next"] < 0.03
    a, b, none = len(texts), len(texts) + 2, len(texts) + 4  # each is followed by one of its kind
    assert all(0.4 < got[k]["near_edited"] < 0.8 and got[k]["near_next"] < 0.05 for k in (a, b))
    assert got[none]["near_edited"] == got[none]["near_next"] == 1 and got[none + 1]["near_edited"] == 1 and got[none + 1]["near_next"] == 0


def test_ids_may_be_texts(spark):
    """Ranges of ids, and what comes next, go by the ids' own order."""
    rows = [(f"id{k:03d}", f"text number {k}. and its end", "s") for k in range(60)] + [(None, "no id", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    got = {r["doc_id"]: r for r in multiset_hash.with_edits(docs).collect()}
    for k, (i, t, _) in enumerate(ordered):
        quarter = len(t) // 4
        assert got[i]["edited_sha256"] == sha(t[: len(t) - quarter] + ordered[(k + 1) % len(ordered)][1][:quarter])
    shards = sharding.sharded(docs, 6).collect()
    homes = [{r["doc_id"]: r["shard"] for r in shards}[i] for i, *_ in ordered]
    assert len(shards) == 61 and homes == sorted(homes)


# 5


def test_archives_give_every_page_back(spark):
    page = "<html>" + "x" * 200
    rows = [(1, "http://a/1", page), (2, "http://a/2\r\nX: y", page), (3, None, "é" * 60), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", page), (None, "u", page), (3, None, "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in wacz.read_records(wacz.write_archives(pages), with_payload=True).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == page and i != 1
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None, None if again else raw] += 1
    assert {(*k[:5], bytes(k[5]) if k[5] is not None else None): n for k, n in got.items()} == dict(want)


def test_one_archive_is_read_by_many_tasks(spark, monkeypatch):
    """Stretches of an archive go to tasks of their own; one page's copies are a third of all."""
    monkeypatch.setattr(wacz, "READ_BYTES", 4096)
    rows = [(k, f"http://a/{k}", "<html>" + ("copy" * 50 if k % 3 == 0 else sha(str(k)) * 8)) for k in range(600)]
    manifest = wacz.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    read = wacz.read_records(manifest)
    assert manifest.count() < read.rdd.getNumPartitions() == 4
    got = read.select("page", "record_type", "refers_to", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in got}) > 1
    assert {(r["page"], r["record_type"], r["refers_to"]) for r in got} == {(k, "revisit" if k % 3 == 0 and k else "response", 0 if k % 3 == 0 and k else None) for k, _, _ in rows}


def test_an_index_is_read_in_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(wacz, "INDEX_BYTES", 7)
    lines = [b"a" * k for k in range(1, 30)]
    raw = b"xx" + b"\n".join(lines)
    for tail in (b"", b"\n"):
        with pa.BufferReader(raw + tail + b"other") as f:
            assert [x for part in wacz.index_lines(f, 2, len(raw) - 2 + len(tail)) for x in part] == lines


def test_joins_with_hot_keys_lose_nothing(spark):
    rows = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("k"))
    one = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 14)], "k long, v long"))
    for least in (0, 10_000):
        for how in ("inner", "left"):
            got = Counter(tuple(r) for r in _joins.split_join(rows, one, ["k"], how, least).select("id", "k", "v").collect())
            assert got == Counter(tuple(r) for r in rows.join(one, ["k"], how).select("id", "k", "v").collect())
    assert [r["k"] for r in _joins.hot_keys(rows.dropna(), ["k"]).collect()] == [7]


def test_zip_directories_with_and_without_zip64(tmp_path):
    import zipfile

    import pyarrow as pa

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"stored")
        z.writestr("é/b", b"other")
        z.writestr(zipfile.ZipInfo("packed"), b"p" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK a comment"
    with pa.OSFile(str(path)) as f:
        found = wacz.members(f)
        assert {n: wacz._read(f, *at) for n, at in found.items()} == {"big": b"stored", "é/b": b"other"}
    raw = path.read_bytes()
    end = raw.rfind(b"PK\x05\x06")
    entries, size, start = 3, *__import__("struct").unpack_from("<II", raw, end + 12)
    struct = __import__("struct")
    far = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, size, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    last = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path.write_bytes(raw[:end] + far + locator + last)
    with pa.OSFile(str(path)) as f:
        assert wacz.members(f) == found
    path.write_bytes(b"not a zip file")
    with pa.OSFile(str(path)) as f, pytest.raises(ValueError):
        wacz.members(f)


# 6 and 10


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


def test_tokens_are_the_librarys(docs, library):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in bpe.encoded(docs, queries.vocabulary_path()).collect())
    want = Counter()
    for i, t, *_ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), ",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_any_text_is_split_and_merged_as_by_the_library(library):
    import random

    v = bpe.Vocabulary(open(queries.vocabulary_path(), encoding="utf-8").read())
    r = random.Random(7)
    for _ in range(1500):
        text = "".join(r.choice("  '\n\tstmdrevl!é1x日\u0085 \x1c🎉ab") for _ in range(r.randrange(40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert v.encode(text) == ids and v.decode(ids) == library.decode(ids, skip_special_tokens=False)
    word = ("ab" * 300).encode()
    assert v._heap([v.single[b] for b in word]) == library.encode(word.decode(), add_special_tokens=False).ids


def test_length_report_answers_every_limit(docs, library):
    sizes = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in corpus()]
    report = lengths.length_report(docs, queries.vocabulary_path())
    for r in report.collect():
        at = r["n_tokens"]
        assert r["n_docs"] == sizes.count(at) and r["docs_from"] == sum(s >= at for s in sizes) and r["tokens_from"] == sum(s for s in sizes if s >= at)
        assert r["tokens_cut"] == sum(min(s, at) for s in sizes) and r["share_within"] == pytest.approx(sum(s <= at for s in sizes) / len(sizes))
    assert {(r["context"], r["docs_longer"], r["tokens_cut"]) for r in lengths.at_limits(report, [10, 100]).collect()} == {(c, sum(s > c for s in sizes), sum(min(s, c) for s in sizes)) for c in (10, 100)}
    assert lengths.quantile(report, 0.5) == sorted(sizes)[-(-len(sizes) // 2) - 1]


# 7


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "Beta gamma, delta epsilon zeta eta theta iota lambda mu"), (3, "one two three"), (10, "two"), (4, ""), (5, None), (2, "x y z w v u t s r")]
PASSAGES = [
    "before alpha beta gamma delta epsilon zeta eta theta after",
    "ALPHA beta gamma delta epsilon zeta eta theta iota kappa beta gamma delta epsilon zeta eta theta iota",
    "one two three one two", "nothing here", None, "", "beta gamma delta epsilon zeta eta theta", "é one two  three-alpha",
    "x y z w v u t s r q", "alpha beta gamma delta epsilon zeta eta theta iota lambda mu",
]


def plain_matches(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    mine, hit, ids = words(text), set(), set()
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            part = w[k : k + 8]
            for at in range(len(mine) - len(part) + 1):
                if mine[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    ids.add(i)
    return len(mine), len(hit), len(ids), ",".join(sorted(map(str, ids)))


@pytest.mark.parametrize("most", [2_000_000, 12])
def test_matches_are_those_of_all_windows(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "MOST_WORDS", most)
    docs = frame(spark, [(k, t, None, None, 0) for k, t in enumerate(PASSAGES)])
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    for items in (ITEMS, [x for x in ITEMS if len((x[1] or "").split()) >= 8]):
        bench = spark.createDataFrame(items, "item_id int, text string")
        got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), r["n_items"], ",".join(r["items"])) for r in decontam.matches(docs, bench).collect()}
        assert got == {k: plain_matches(t, items) for k, t in enumerate(PASSAGES)}


def test_automaton_on_random_words():
    import random

    r = random.Random(2)
    for _ in range(150):
        items = [(k, " ".join(r.choice("abc") for _ in range(r.randrange(14)))) for k in range(4)]
        text = " ".join(r.choice("abcd") for _ in range(60))
        a = decontam.Automaton([(str(i), decontam.word_hashes(decontam.words_of(t))) for i, t in items], 8)
        for made in (a, decontam.Automaton.unpacked(a.packed())):
            found = [*made.match(decontam.word_hashes(decontam.words_of(text)))]
            hit = {k for end, size, _ in found for k in range(end - size, end)}
            ids = {made.item_names[i] for *_, mine in found for i in mine}
            assert (60, len(hit), len(ids), ",".join(sorted(ids))) == plain_matches(text, items)


def test_many_slices_say_what_one_says(spark, monkeypatch):
    """Items dealt to many slices, a long item in pieces, documents in groups, slices that a worker can't keep."""
    import random

    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, prose(r.randrange(1, 40))) for k in range(60)] + [(99, prose(700))]
    texts = [prose(r.randrange(80)) + " " + " ".join(items[r.randrange(len(items))][1].split()[5:60]) for _ in range(40)]
    docs = frame(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)]).repartition(2)
    bench = spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(decontam, "MOST_WORDS", 200)
    monkeypatch.setattr(decontam, "PIECE_WORDS", 100)
    monkeypatch.setattr(decontam, "GROUP_BYTES", 500)
    monkeypatch.setattr(decontam, "KEPT_BYTES", 20_000)
    assert len(decontam.slices(bench, "item_id", "text", 8)) >= 5
    got = {x["doc_id"]: (x["n_words"], sum(s["end"] - s["first"] for s in x["spans"]), x["n_items"], ",".join(x["items"])) for x in decontam.matches(docs, bench).collect()}
    assert got == {k: plain_matches(t, items) for k, t in enumerate(texts)}


def test_cleaning_keeps_clean_documents(spark):
    filler = " ".join(f"w{k}" for k in range(200))
    rows = [(1, filler, None, None, 1), (2, None, None, None, None), (3, f"{filler} alpha beta gamma delta epsilon zeta eta theta {filler}", None, None, 9), (4, ITEMS[0][1], None, None, 3), (5, "", None, None, 0)]
    bench = spark.createDataFrame(ITEMS[:2], "item_id int, text string")
    got = {r["doc_id"]: r for r in decontam.cleaned(frame(spark, rows), bench).collect()}
    assert 4 not in got and got[1]["text"] == filler and got[2]["text"] is None and got[5]["text"] == ""
    assert got[3]["text"] == f"{filler}  {filler}" and got[3]["n_chars"] == len(got[3]["text"])
    assert 3 not in {r["doc_id"] for r in decontam.cleaned(frame(spark, rows), bench, longest=8).collect()}


# 8


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = queries.op8_naive_bayes_language(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = found.collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scores_are_those_of_a_plain_bayes(spark):
    train = [(1, "the cat and the dog", "en", "s", 0), (2, "le chat et le chien", "fr", "s", 0), (3, None, "en", "s", 0), (4, "x", None, "s", 0)]
    model = langid.fit(frame(spark, train))
    assert model.languages == ["en", "fr"]
    text = "the chien 12"
    buckets = lambda t: np.concatenate([b for _, b in langid.grams([t])]).tolist()
    # a gram is of code points, of which no two begin it that aren't letters
    plain = "".join(c if "a" <= c <= "z" else " " for c in text)
    assert len(buckets(text)) == sum(plain[k : k + 2] != "  " for n in (2, 3) for k in range(len(plain) - n + 1))
    assert len(buckets("日本語")) == 3 and sorted(buckets("日本語")) == sorted(np.concatenate([b for _, b in langid.grams(["", "日本語", "x"])]).tolist())
    totals = []
    for k, lang in enumerate(model.languages):
        counts = Counter(buckets(train[k][1]))
        whole = sum(counts.values()) + langid.ALPHA * langid.BUCKETS
        totals.append(np.log(0.5) + sum(np.log((counts[g] + langid.ALPHA) / whole) for g in buckets(text)))
    predicted, score = model.scores([text, None, "", "12 !", "the " * 200_000])
    assert predicted[0] == model.languages[int(np.argmax(totals))] and score[0] == pytest.approx(1 / np.exp(np.array(totals) - max(totals)).sum(), rel=1e-3)
    assert predicted[1:4] == ["und"] * 3 and predicted[4] == "en"
    assert langid.fit(frame(spark, [])).scores(["text"]) == (["und"], [0.0])


def test_pieces_of_long_texts_have_all_grams(monkeypatch):
    texts = ["ab", "", "the quick brown fox " * 9, "x", "日本語テスト " * 20]
    want = Counter((k, b) for k, text in enumerate(texts) for _, part in langid.grams([text]) for b in part.tolist())
    monkeypatch.setattr(langid, "PIECE", 10)
    assert Counter((k, b) for rows, part in langid.grams(texts) for k, b in zip(rows.tolist(), part.tolist(), strict=True)) == want


def test_rare_labels_are_learned(spark):
    rows = [(k, f"the cat and the dog number {k}", "en", None, 0) for k in range(400)] + [(900 + k, "le chat et le chien", "fr", None, 0) for k in range(3)]
    model = langid.fit(frame(spark, rows), most_rows=40)
    assert model.languages == ["en", "fr"] and model.scores(["le chien", "the dog"])[0] == ["fr", "en"]
    assert 0.005 < np.exp(model.log_prior[1]) < 0.02


# 9


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("cells", [7, 50_000])
def test_shards_are_minimax(spark, docs, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    rows, got = corpus(), sharding.sharded(docs, 6).collect()
    assert len(got) == len(rows)
    groups: dict = {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 8
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    sums = {k: sum(r["size"] for r in v) for k, v in by_shard.items()}
    first = {}
    for i, t, *_ in rows:
        key = (i is not None, i or 0)
        first[t] = min(first.get(t, key), key)
    ordered = [groups[t] for t in sorted(groups, key=lambda t: first[t])]
    assert max(sums.values()) == brute_capacity(ordered, 6)
    for v in by_shard.values():
        assert sorted(r["slot"] for r in v) == [*range(len(v))]
    import zlib as z

    text_of = defaultdict(set)
    for i, t, *_ in rows:
        text_of[len((t or "").encode()) + 8, z.crc32((t or "").encode())].add(t)
    homes = defaultdict(set)
    for r in got:
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(homes[k]) <= len(v) for k, v in text_of.items())


def test_balanced_cuts_fit_the_capacity():
    import random

    r = random.Random(4)
    for _ in range(300):
        ends, at = [], 0
        for _ in range(r.randrange(1, 60)):
            at += r.randrange(1, 50)
            ends.append(at)
        n = r.randrange(1, 9)
        low = max(b - a for a, b in zip([0, *ends], ends, strict=False))
        cap = sharding.smallest_capacity(ends, max(low, -(-at // n)), n)
        cuts = sharding.balanced(ends, cap, n)
        assert cuts[-1] == at and len(cuts) == n and all(0 <= b - a <= cap for a, b in zip([0, *cuts], cuts, strict=False))


# all


def test_empty_tables(spark, none):
    bench = spark.createDataFrame(ITEMS[:0], "item_id int, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [
        secrets.secret_spans(none), simhash.near_duplicates(none), simhash.similar_documents(none), simhash.without_near_duplicates(none), line_dedup.keep_bitmaps(none), line_dedup.without_repeated_lines(none), multiset_hash.with_edits(none), wacz.read_records(wacz.write_archives(pages)),
        lengths.length_report(none, queries.vocabulary_path()), decontam.matches(none, bench), langid.accepted(none, langid.fit(none)), sharding.sharded(none), bpe.encoded(none, queries.vocabulary_path()),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_extra_columns_with_clashing_names(spark):
    extra = ["_dropped", "_own_row", "_line_id", "spans", "items", "n_words", "score", "lang_pred", "_kept", "id", "row", "hash", "fp", "component_id", "_range", "_text", "shard"]
    docs = frame(spark).select("*", *[F.lit(7).alias(c) for c in extra])
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    n = len(corpus())
    for df, rows in ((line_dedup.without_repeated_lines(docs), n), (decontam.cleaned(docs, bench), None), (langid.accepted(docs, langid.fit(docs)), None), (simhash.without_near_duplicates(docs), None)):
        assert df.columns == docs.columns and all(r["_dropped"] == r["score"] == r["spans"] == 7 for r in df.collect())
        assert rows is None or df.count() == rows
    for df in (secrets.secret_spans(docs), simhash.near_duplicates(docs), simhash.similar_documents(docs), bpe.encoded_digests(docs, queries.vocabulary_path()), multiset_hash.with_edits(docs), sharding.sharded(docs), line_dedup.keep_bitmaps(docs)):
        assert df.count() == n


