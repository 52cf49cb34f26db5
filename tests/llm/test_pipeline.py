"""The pipeline as registered, beside a plain version of what its stages leave."""

from __future__ import annotations

import re
import zlib

import numpy as np

from racebook.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def groups(texts: dict[int, str]) -> dict[int, int]:
    """Smallest id reachable by links of 80 % of the 5-word shingles, from counts of shared shingles."""
    sets, holders = {}, {}
    for i, text in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        both = {}
        for s in sets[i]:
            for j in holders[s]:
                both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if j > i and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def without_earlier(texts: dict[int, str]) -> dict[int, bytes]:
    seen, out = set(), {}
    for i in sorted(texts):
        text = texts[i].encode()
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - 99):
            if text[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(text[at : at + 100])
        out[i] = bytes(np.frombuffer(text, "u1")[~gone])
    return out


def test_run_leaves_what_a_plain_version_leaves(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = read_table(spark, SF, "documents")
    given = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:2]:  # the two learned stages; their rules are tested by themselves
        docs = stage(spark, docs, SF)
    judged = {r.doc_id: r.text for r in docs.collect()}
    assert all(judged[i] == given[i] and len(judged[i].split()) >= 50 for i in judged) and 0 < len(judged) < len(given)
    component = groups(judged)
    cut = without_earlier({i: t for i, t in judged.items() if component[i] == i})
    left = {i: b.decode(errors="ignore") for i, b in cut.items() if b.strip()}
    assert len(left) < len(judged) and any(left[i] != judged[i] for i in left)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in left.items()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == set(ids)
    ends, filled = dict.fromkeys(ids, 0), {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == ends[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        ends[p.doc_id] += p.length
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert ends == {i: len(x) for i, x in ids.items()}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 4096
