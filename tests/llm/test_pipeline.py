"""Each stage of the corpus pipeline against a plain version, on its own input; awkward rows in every column."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import bpe, langid, queries
from gaugeworks.llm._io import written
from tests.llm.corpus import corpus, frame
from tests.llm.test_operators import plain_lines

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_language(docs):
    """Documents with a letter."""
    return {r["doc_id"]: r["text"] for r in docs if r["text"] and any(map(str.isalpha, r["text"]))}


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_classes(texts: dict, limit: float) -> dict:
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x == y or (x | y and len(x & y) / len(x | y) >= limit):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: root(i) for i in ids}


def plain_clean(text: str | None, bench: list[tuple]) -> str | None | bool:
    """The text without benchmark words; False if the document goes."""
    words, hit, items = plain_words(text), set(), set()
    for item, t in bench:
        w = plain_words(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            part = w[k : k + 8]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    items.add(item)
    if not hit:
        return text
    runs = [len(list(x)) for x in np.split(sorted(hit), np.flatnonzero(np.diff(sorted(hit)) > 1) + 1)]
    if len(items) > 1 or max(runs) >= corpus_pipeline.LEAKED_WORDS or len(hit) >= 0.1 * len(words):
        return False
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
    out, at, run = [], 0, sorted(hit)
    for k, w in enumerate(run):
        if not k or run[k - 1] != w - 1:
            out.append(text[at : places[w][0]])
        at = places[w][1]
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage, and what the last gives."""
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_are_those_of_the_operators(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language_stage(stages):
    assert texts(stages[1]) == plain_language(stages[0].collect())


def test_line_stage(stages):
    want = {w[0]: w[4] for w in plain_lines([*texts(stages[1]).items()])}
    assert texts(stages[2]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    sure, perhaps = plain_classes(before, 0.83), plain_classes(before, 0.73)
    assert all(after[i] == before[i] for i in after)
    # what is surely alike goes, what surely isn't stays; each class keeps one
    assert all(not (i in after and sure[i] != i and sure[i] in after) for i in before)
    assert {i for i, c in perhaps.items() if c == i} <= set(after)
    assert Counter(sure.values()).most_common(1)[0][1] > 1


def test_decontamination_stage(spark, stages):
    bench = [(r["item_id"], r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    want = {i: t for i, x in texts(stages[3]).items() if (t := plain_clean(x, bench)) is not False}
    assert texts(stages[4]) == want and len(want) < len(texts(stages[3]))


def test_encoding_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    want = {}
    for i, t in texts(stages[4]).items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages[5].collect()} == want


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, an extra column with a clashing name."""
    rows = [*corpus(), (None, None, None, None, None), (None, "a text of its own without an id", None, None, None), (4, "another text of a repeated id", "en", "s", 1)]
    docs = frame(spark, rows).withColumn("_node", F.lit(5)).withColumn("score", F.lit(6)).withColumn("w0", F.lit(7)).withColumn("key", F.lit(8))
    for name, stage in corpus_pipeline.STAGES:
        docs, before = written(stage(spark, docs, SF), name), docs
        if name != "bpe":
            assert docs.columns == before.columns and all((r["_node"], r["score"], r["w0"], r["key"]) == (5, 6, 7, 8) for r in docs.collect())
        if name == "near_dedup":
            kept = [r["text"] for r in docs.collect()]
            assert "a text of its own without an id" in kept and "another text of a repeated id" in kept
    assert docs.count() > 0


def test_stages_on_empty_tables(spark):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_a_vocabulary_with_unknown_parts_is_refused():
    import json

    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"added_tokens": [{"id": 0, "content": "<x>", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(spec | change))
    assert langid.UND == "und"
