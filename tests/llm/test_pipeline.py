"""Stages of the pipeline against brute force on a small corpus."""

import re
import zlib

import numpy as np
import pytest
from test_operators import DOCS, LABELS, WORD, corpus, shingles

import corpus_pipeline
from reelgrid.llm import bpe, packing, suffixes
from reelgrid.llm.tables import written


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("pipeline"))
    rows = corpus()[:-2]  # ids are unique here
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(r[0], 0, 0) for r in rows if r[1] and ("%%%" in r[1] or r[1].startswith("a b"))], LABELS).write.parquet(f"{home}/labels.parquet")
    docs, out = spark.read.parquet(f"{home}/documents.parquet"), {}
    out["documents"] = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = written(stage(spark, docs, home), name)
        assert docs.columns == columns
        out[name] = {r.doc_id: r for r in docs.collect()}
    out["packing"] = corpus_pipeline.STAGES[-1][1](spark, docs, home).collect()
    return home, out


def test_quality_keeps_clean_documents(stages):
    docs, kept = stages[1]["documents"], stages[1]["quality"]
    assert set(range(60)) <= set(kept)
    assert not any("%%%" in (r.text or "") or not WORD.search(r.text or "") for r in kept.values())
    assert all(kept[i].text == docs[i].text for i in kept)


def test_lines_go(stages):
    before, after = stages[1]["quality"], stages[1]["lines"]
    assert set(before) == set(after)
    assert not any("Read more at our site now" in r.text for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_one_document_of_each_group(stages):
    before, after = stages[1]["lines"], stages[1]["near_duplicates"]
    sets = {i: shingles(r.text, 5) for i, r in before.items()}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    assert set(after) == {i for i in sets if root(i) == i} and len(after) < len(before)


def test_repeats_go(stages):
    before, after = stages[1]["near_duplicates"], stages[1]["repeats"]
    assert set(before) == set(after)
    seen, changed = set(), 0
    for i in sorted(before):
        raw = before[i].text.encode()
        cover, own = bytearray(len(raw)), set()
        for p in range(len(raw) - 49):
            own.add(raw[p : p + 50])
            if raw[p : p + 50] in seen:
                cover[p : p + 50] = b"\1" * 50
        seen |= own
        spans = [m.span() for m in re.finditer(b"\1+", bytes(cover))]
        want = suffixes.cut(raw, *suffixes.whole_characters(raw, [a for a, _ in spans], [b for _, b in spans])).decode()
        changed += bool(spans)
        assert after[i].text == want and after[i].n_chars == len(want)
    assert changed


def test_packed(stages):
    docs, tok = stages[1]["repeats"], bpe.tokenizer(packing.BPE_50K)
    total = 0
    for r in stages[1]["packing"]:
        ids = np.array(tok.encode(docs[r.doc_id].text, add_special_tokens=False).ids + [1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        total += r.length
    assert total == sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.values())


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, stages[0]).collect()
    # Where documents are cut depends on how the table is split; what is packed does not.
    packed = lambda pieces: {i: (sum(r.length for r in pieces if r.doc_id == i), {r.doc_tokens for r in pieces if r.doc_id == i}) for i in {r.doc_id for r in pieces}}
    assert packed(rows) == packed(stages[1]["packing"]) and all(n == total for n, (total,) in packed(rows).values())
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in windows.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(n for _, n in own) <= packing.WINDOW


def test_lines_of_blocks_and_text_ends_go(spark):
    """Blocks with constant neighbours, lines at text ends, and a group of copies that holds a line; copies keep their own lines."""
    texts = [(f"own {i}\nLes\nTerms apply\nend {i}", f"s{i % 7}") for i in range(14)]
    texts += [(f"mine {i}\nAll rights\nreserved", f"s{i}") for i in range(6)] + [(f"Skip to content\nbody {i}", f"s{i}") for i in range(6)]
    texts += [(f"few {i}\nfive sites", f"s{i % 5}") for i in range(20)]
    texts += [("copied\nwhole\nTerms apply", f"s{i}") for i in range(40)] + [(None, "s1"), ("", None)]
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, (t, s) in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    sites, wholes = {}, {}
    for t, s in texts:
        for line in (t or "").split("\n"):
            sites.setdefault(line, set()).add(s or "")
            wholes.setdefault(line, set()).add(t or "")
    bad = {x for x in sites if WORD.search(x) and len(sites[x]) >= 6 and len(wholes[x]) >= 6}
    assert bad == {"Les", "Terms apply", "All rights", "reserved", "Skip to content"}
    got = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, "").collect()}
    for i, (t, _) in enumerate(texts):
        left = None if t is None else "\n".join(x for x in t.split("\n") if x not in bad)
        assert got[i].text == left and (left is None or got[i].n_chars == len(left))
